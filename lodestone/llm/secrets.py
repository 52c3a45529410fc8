"""Secret scan: assignments, access keys, long hex strings, and candidate strings with a window of high entropy.

A candidate is a maximal run of the characters of base 64. A window of WINDOW characters slides over it; the counts of
the window's characters are kept up to date as one character enters and one leaves, and the sum of c * log2(c) over the
counts with them, in fixed point, so equal windows have equal sums in any order. The entropy that is needed depends on
the character class of the candidate. Candidates on the allow-list are passed over.

DataFrame functions only. Positions are code points, ends exclusive. Null texts are empty ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are taken whole, so a lower bound on their length drops the same ones as a test afterwards.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE = 6

WINDOW = 24
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits a character that a window needs, by the class of the candidate; the first class that fits counts.
CLASSES = ((r"^[0-9]+\z", 3.2), (r"^[0-9A-Fa-f]+\z", 3.0), (r"^[A-Za-z]+\z", 4.0), (r"", 3.8))
#: Placeholders, alphabets and digits in order, one character over and over, UUIDs, words joined by hyphens or underscores, paths.
ALLOWED = (
    r"(?i)example|placeholder|sample|changeme|dummy|redacted|xxxx",
    r"(?i)abcdefghij|0123456789|1234567890",
    r"^(.)\1*\z",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z",
    r"^[A-Za-z]{1,16}([-_/=][A-Za-z]{0,16})++\z",
    r"^[-_=+/]+",
)
#: For scan(whole=True): what suppresses the windows that it is in, but not the rest of the candidate; and candidates, or
#: pieces of them, that are passed over whole: those above but for the first two, separator lines, and paths of short plain segments.
PLACEHOLDERS = r"(?i)example|placeholder|sample|changeme|dummy|redacted|xxxx|abcdefghij|0123456789|1234567890"
_SEGMENT = "(?:(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,16})[0-9]{0,4}|[0-9]{1,4})"
PASSED = (*ALLOWED[2:5], r"^[-_=+/]+\z", rf"^[-_=+/]+{_SEGMENT}(?:[-_=+/]+{_SEGMENT})*+[-_=+/]*\z")
SCALE = 1 << 20
#: Elements of a block of _running(), characters of a part of redact().
BLOCK, PART = 128, 4096
#: Bits of a count in the state of a window: up to 31, above WINDOW.
FIELD = 5


def weight(c: int) -> int:
    """c * log2(c) in fixed point."""
    return round(c * math.log2(c) * SCALE) if c else 0


def most(bits: float) -> int:
    """A window has at least so many bits a character if its weights sum to no more than this."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(array: str, step: str = "n + x") -> str:
    """SQL of an array of ints: before each element of array, step over all earlier ones, from 0 (an associative step of n and x).

    In blocks, so that its cost is near that of the elements: a fold over all of them would copy what it has so far at each.
    """
    return f"""transform(array({array}), all_ ->
        transform(array(transform(sequence(0, cast((size(all_) + {BLOCK - 1}) div {BLOCK} as int)), k -> aggregate(slice(all_, k * {BLOCK} + 1, {BLOCK}), 0, (n, x) -> {step}))), sums ->
            flatten(transform(sums, (own, k) -> aggregate(slice(all_, k * {BLOCK} + 1, {BLOCK}),
                named_struct('at', aggregate(slice(sums, 1, k), 0, (n, x) -> {step}), 'out', cast(array() as array<int>)),
                (st, x) -> named_struct('at', aggregate(array(x), st.at, (n, x) -> {step}), 'out', array_append(st.out, st.at)),
                st -> st.out))))[0])[0]"""


def _found(text: str, pattern: str, fields: dict[str, str], least: str = "") -> str:
    """SQL of the matches in order, as structs of fields: SQL by name of m (f: matches, p: what is between), i, start and end.

    least: further arrays of m, as SQL for named_struct. Texts without a match cost one search. All arrays are variables
    of lambdas, and so are made once each, not once for each element.
    """
    q = _quoted(pattern)
    made = ", ".join(f"'{name}', {sql}" for name, sql in fields.items())
    kind = "array<struct<" + ",".join(f"{name}:{'string' if name in ('x', 'v') else 'int'}" for name in fields) + ">>"
    lengths = "transform(m.f, (x, i) -> length(m.p[i]) + length(x))"
    return f"""case when {text} rlike {q} then transform(array(named_struct('f', regexp_extract_all({text}, {q}, 0), 'p', split({text}, {q}, -1){least})),
        m -> transform(array({_running(lengths)}), before -> transform(before, (at, i) -> transform(array(named_struct('start', at + length(m.p[i]), 'end', at + length(m.p[i]) + length(m.f[i]))), s -> named_struct({made}))[0]))[0])[0]
        else cast(array() as {kind}) end"""


def _hot(candidate: str, limit: str) -> str:
    """SQL of the span, within the candidate, from the first to the last window of high entropy; null if there is none.

    The state has the counts of the window's characters (FIELD bits each, several in one long), the sum of their weights,
    and the span so far. The window that ends before character i is judged as i comes, so there is one step after the last
    character; sym has the character's place in the counts.
    """
    weights = ", ".join(f"{weight(c)}L" for c in range(WINDOW + 2))
    longs, each = -(-(ord("z") - ord("+") + 1) // (63 // FIELD)), 63 // FIELD
    one = lambda k: f"shiftleft(1L, {FIELD} * cast({k} % {each} as int))"
    held = lambda k: f"cast(shiftright(st.n[{k} div {each}], {FIELD} * cast({k} % {each} as int)) & {(1 << FIELD) - 1} as int)"
    # How the sum changes if the count at k goes up; down.
    up = lambda k: f"(array({weights})[{held(k)} + 1] - array({weights})[{held(k)}])"
    down = lambda k: f"(array({weights})[{held(k)}] - array({weights})[{held(k)} - 1])"
    # Steps: (character that enters, character that leaves); -1 for none.
    return f"""aggregate(array(named_struct('sym', transform(split({candidate}, ''), y -> ascii(y) - {ord("+")}), 'limit', {limit})), cast(null as struct<start:int,end:int>),
        (nothing, z) -> aggregate(transform(sequence(0, size(z.sym)), i -> named_struct('i', i, 'in', coalesce(get(z.sym, i), -1), 'out', coalesce(get(z.sym, i - {WINDOW}), -1))),
            named_struct('n', array_repeat(0L, {longs}), 'sum', 0L, 'start', -1, 'end', -1),
            (st, x) -> named_struct(
                'n', case when x.in = x.out or x.in < 0 then st.n when x.out < 0 then transform(st.n, (v, j) -> case when j = x.in div {each} then v + {one("x.in")} else v end)
                     else transform(st.n, (v, j) -> v + case when j = x.in div {each} then {one("x.in")} else 0L end - case when j = x.out div {each} then {one("x.out")} else 0L end) end,
                'sum', case when x.in = x.out or x.in < 0 then st.sum when x.out < 0 then st.sum + {up("x.in")} else st.sum + {up("x.in")} - {down("x.out")} end,
                'start', case when st.start < 0 and x.i >= {WINDOW} and st.sum <= z.limit then x.i - {WINDOW} else st.start end,
                'end', case when x.i >= {WINDOW} and st.sum <= z.limit then x.i else st.end end),
            st -> case when st.start >= 0 then named_struct('start', st.start, 'end', st.end) end))"""


def _pieces(z: str) -> str:
    """SQL of the parts (x, at) of the candidate z between placeholders."""
    q = _quoted(PLACEHOLDERS)
    return f"""case when not {z}.x rlike {q} then array({z}) else transform(array(named_struct('p', split({z}.x, {q}, -1), 'f', regexp_extract_all({z}.x, {q}, 0))),
        y -> transform(array({_running("transform(y.p, (x, i) -> length(x) + coalesce(length(get(y.f, i)), 0))")}), before -> transform(before, (n, i) -> named_struct('x', y.p[i], 'at', {z}.at + n)))[0])[0] end"""


def _hidden(spans: str, whole: bool) -> str:
    """SQL: whether one of the spans, which are in order and apart, covers e, or (not whole) overlaps it; by bisection."""
    before = f"""aggregate(transform(sequence(0, length(bin(size({spans})))), b -> shiftleft(1, length(bin(size({spans}))) - b)), 0,
        (lo, step) -> case when lo + step <= size({spans}) and {spans}[lo + step - 1].start {"<= e.start" if whole else "< e.end"} then lo + step else lo end)"""
    return f"(size({spans}) > 0 and coalesce(transform(array({before}), at -> get({spans}, at - 1).end {'>= e.end' if whole else '> e.start'})[0], false))"


def scan(df: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """Adds secrets: array of (kind, start, end), by start, then kind as in KINDS.

    Entropy spans that overlap one of the other kinds are left out. A column secrets of the input is replaced.
    whole: placeholders suppress only the windows that they are in, a leading separator suppresses nothing (PASSED), and
    entropy spans are left out only if one span of another kind covers them.

    Null and empty texts have no spans; repeated rows have the same each. The work for one text follows its length and the
    number of its matches, whatever these are (a hundred thousand in one text take seconds).
    """
    span = {"start": "s.start", "end": "s.end"}
    there = df.withColumn("__t", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    values = f", 'v', regexp_extract_all(__t, {_quoted(ASSIGN)}, 2)"
    assign = _found("__t", ASSIGN, span | {"v": "m.v[i]"}, values)
    there = there.withColumn("__s_assign", F.expr(f"transform(filter({assign}, s -> length(s.v) >= {MIN_VALUE}), s -> named_struct('start', s.start, 'end', s.end))"))
    there = there.withColumns({f"__s_{name}": F.expr(_found("__t", pattern, span)) for name, pattern in (("access", ACCESS), ("hex", HEX))})
    kept = " and ".join(f"not z.x rlike {_quoted(p)}" for p in (PASSED if whole else ALLOWED))
    candidates = f"filter({_found('__t', CANDIDATE, {'x': 'm.f[i]', 'at': 's.start'})}, z -> {kept})"
    if whole:
        candidates = f"filter(flatten(transform({candidates}, z -> {_pieces('z')})), z -> length(z.x) >= {WINDOW} and {kept})"
    limit = "case " + " ".join(f"when z.x rlike {_quoted(p)} then {most(bits)}L" for p, bits in CLASSES[:-1]) + f" else {most(CLASSES[-1][1])}L end"
    there = there.withColumn("__h", F.expr(f"filter(transform({candidates}, z -> named_struct('at', z.at, 'hot', {_hot('z.x', limit)})), w -> w.hot is not null)"))
    parts = [f"transform(y.{k}, s -> named_struct('start', s.start, 'o', {o}, 'end', s.end))" for o, k in enumerate(KINDS[:3])]
    hidden = " or ".join(_hidden(f"y.{k}", whole) for k in KINDS[:3])
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    made = F.expr(f"""transform(array(named_struct('h', __h, 'assign', __s_assign, 'access', __s_access, 'hex', __s_hex)), y ->
        transform(array_sort(concat({", ".join(parts)}, filter(transform(y.h, w -> named_struct('start', w.at + w.hot.start, 'o', 3, 'end', w.at + w.hot.end)), e -> not ({hidden})))),
            s -> named_struct('kind', {names}[s.o], 'start', s.start, 'end', s.end)))[0]""")
    return there.withColumn("secrets", made).select(*[F.col(f"`{c}`") for c in df.columns if c != "secrets"], "secrets")


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The text with each span of secrets (overlapping ones together) replaced by mark. Texts without spans stay, null ones too.

    A string finds its n-th character by walking there, so the text is first cut into parts of PART characters, and what
    stays is put together from these.
    """
    t = f"`{text}`"
    ends = _running("transform(q, s -> s.end)", "greatest(n, x)")
    # Spans by start; each that starts where all before it have ended begins a new one.
    merged = f"""transform(array(secrets), q -> transform(array({ends}), past -> transform(array(filter(sequence(0, size(q) - 1), i -> q[i].start >= past[i])), first ->
        transform(first, (i, g) -> named_struct('start', q[i].start, 'end', case when g + 1 < size(first) then past[first[g + 1]] else array_max(transform(q, s -> s.end)) end)))[0])[0])[0]"""
    first, last = f"cast(r.a div {PART} as int)", f"cast(r.b div {PART} as int)"

    def between(start: str, end: str) -> str:
        """What stays from start to end: the end of a part, whole parts, the beginning of a part."""
        return f"""aggregate(array(named_struct('a', {start}, 'b', {end})), '', (none, r) -> case when r.a >= r.b then ''
            when {first} = {last} then substring(c[{first}], r.a % {PART} + 1, r.b - r.a)
            else concat(substring(c[{first}], r.a % {PART} + 1), array_join(slice(c, {first} + 2, {last} - {first} - 1), ''), coalesce(substring(get(c, {last}), 1, r.b % {PART}), '')) end)"""

    redacted = f"""transform(array(named_struct('m', {merged}, 'c', regexp_extract_all({t}, '(?s).{{1,{PART}}}', 0))), y -> transform(array(y.c), c -> concat(
        array_join(transform(y.m, (s, i) -> concat({between("case when i = 0 then 0 else y.m[i - 1].end end", "s.start")}, {_quoted(mark)})), ''),
        {between("element_at(y.m, -1).end", f"length({t})")}))[0])[0]"""
    return df.withColumn(text, F.expr(f"case when size(secrets) > 0 and {t} is not null then {redacted} else {t} end"))


def oracle() -> str:
    """The query's rows (whole=True) in DuckDB's SQL; windows are counted anew at each place."""
    # RE2 has no possessive repeats, which only spare Java its stack here.
    q = lambda p: _literal(p.replace(")++", ")+").replace(")*+", ")*"))
    table = "[" + ", ".join(str(weight(c)) for c in range(WINDOW + 1)) + "]"
    # Nor back references: one character over and over is told by removing it.
    passed = " or ".join(f"regexp_matches(x, {q(p)})" for p in PASSED if r"\1" not in p) + " or replace(x, x[1], '') = ''"
    limit = "case " + " ".join(f"when regexp_matches(x, {q(p)}) then {most(bits)}" for p, bits in CLASSES[:-1]) + f" else {most(CLASSES[-1][1])} end"
    kinds = [("assign", 0, ASSIGN), ("access", 1, ACCESS), ("hex", 2, HEX), ("entropy", 3, CANDIDATE)]
    found = " union all ".join(
        f"select doc_id, '{k}' as kind, {o} as o, regexp_extract_all(t, {q(p)}, 0) as f, string_split_regex(t, {q(p)}) as p, regexp_extract_all(t, {q(p)}, {2 if k == 'assign' else 0}) as v from t" for k, o, p in kinds
    )
    hot = f"list_filter(range(0, length(x) - {WINDOW} + 1), lambda i: list_sum(list_transform(map_values(list_histogram(string_split(x[i + 1:i + {WINDOW}], ''))), lambda c: {table}[cast(c + 1 as bigint)])) <= lim)"
    return f"""with t as (select doc_id, coalesce(text, '') as t from documents), m as ({found}),
        s as (select doc_id, kind, o, f[i] as x, v[i] as v, list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0) as start from (select *, unnest(range(1, len(f) + 1)) as i from m)),
        base as (select doc_id, kind, o, cast(start as bigint) as start, cast(start + length(x) as bigint) as stop from s where kind <> 'entropy' and (kind <> 'assign' or length(v) >= {MIN_VALUE})),
        cut as (select doc_id, start, string_split_regex(x, {q(PLACEHOLDERS)}) as p, regexp_extract_all(x, {q(PLACEHOLDERS)}, 0) as f from s where kind = 'entropy' and not ({passed})),
        piece as (select doc_id, p[i] as x, start + coalesce(list_sum(list_transform(p[1:i - 1], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0) as start from (select *, unnest(range(1, len(p) + 1)) as i from cut)),
        c as (select doc_id, x, start, {limit} as lim from piece where length(x) >= {WINDOW} and not ({passed})),
        h as (select doc_id, start, {hot} as w from c),
        e as (select doc_id, 'entropy' as kind, 3 as o, cast(start + list_min(w) as bigint) as start, cast(start + list_max(w) + {WINDOW} as bigint) as stop from h where len(w) > 0),
        every as (select * from base union all select e.* from e where not exists (select 1 from base b where b.doc_id = e.doc_id and b.start <= e.start and e.stop <= b.stop)),
        g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, count(*) filter (kind = 'entropy') as n_entropy,
            string_agg(kind || ':' || start || ':' || stop, ',' order by start, o) as spans, string_agg(kind || ':' || start || ':' || stop, ',' order by start, o) filter (kind <> 'entropy') as basis from every group by 1)
        select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_entropy, 0) as n_entropy, coalesce(spans, '') as spans, sha256(coalesce(basis, '')) as base_sha256 from t left join g using (doc_id)"""


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"
