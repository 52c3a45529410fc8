"""Guards on queries and answers, question types, entities: rules over normalised text, as Columns.

A guard gives a struct (passed, status, reason): refused rows stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicons, text

# Patterns of unsafe queries, of attempts to instruct the engine, and of question types in the order in which they are tried.
UNSAFE = [
    r"how to (?:make|build|create|write|develop|program)\s+(?:a\s+)?(?:malicious\s+)?(?:bomb|explosive|weapon|poison|malware|virus|computer virus|trojan|ransomware|exploit)",
    r"(?:kill|murder|harm|assassinate)\s+(?:someone|people|myself|yourself)",
    r"(?:credit card generator|free ssn|hack passwords|sql injection payload)",
    r"(?:suicide instructions|self-harm method)",
    r"(?:child exploitation|csam)",
]
META = r"^(?:ignore all previous instructions|system prompt|jailbreak|dan mode|who made you|are you gemini)"
QUESTION_TYPES = [
    ("WEATHER", r"\b(?:weather|temperature|forecast|rain|climate today|weather today)\b"),
    ("CAPITAL", r"\b(?:capital|state capital|rajdhani)\b|राजधानी"),
    ("LOCATION", r"\b(?:where|location|located|situated|coast|borders|region)\b|कहाँ|स्थान|स्थित|तट"),
    ("FOUNDER", r"\b(?:who founded|who established|founder|father of|who is the founder)\b|किसने"),
    ("DATE_TIME", r"\b(?:when was|what year|what date|established on|established in|founded in)\b"),
    ("NUMERICAL", r"\b(?:speed of|depth of|distance to|height of|mass of|size of)\b"),
    ("RELATION", r"\bwhat\s+does\s+.+?\s+(?:carry|transport|produce|contain|do|use|provide|include|refer\s+to|mean)\b|\bwhat\s+do\s+.+?\s+(?:carry|transport|produce|contain|do|use|provide|include)\b|\bhow\s+does\s+.+?\s+work\b|(?:क्या).*(?:करता|करती|करते|ले जाता|ले जाती|ले जाते)"),
    ("DEFINITION", r"\b(?:what is|what are|define|definition of|meaning of)\b|क्या है|क्या हैं|की परिभाषा|का मतलब क्या है"),
    ("EXPLANATION", r"\b(?:how does|why is|explain|mechanism|algorithm|process|work|works)\b"),
]
HINDI_DATE = r"कब|किस वर्ष|किस साल"


def edged(pattern: str) -> str:
    r"""\b as these patterns mean it; Java's would also see one beside letters of other scripts."""
    return pattern.replace(r"\b", text.EDGE)


def verdict(refused: Column, status: str, reason: str) -> Column:
    return F.struct(
        (~refused).alias("passed"),
        F.when(refused, status).otherwise("PASSED").alias("status"),
        F.when(refused, reason).alias("reason"),
    )


def underspecified(query: Column, generic: list[str] = lexicons.GENERIC_TERMS, compose: bool = False) -> Column:
    """Nothing to search for: no words, a generic phrase, no content words, or up to three words with only generic ones."""
    normal = text.normalize(query, compose)
    words = F.filter(F.split(normal, " "), lambda w: w != "")
    content = text.tokens(normal, lexicons.RERANK_STOP)
    single = (F.size(words) == 1) & (F.get(words, F.lit(0)).isin(generic) | (F.length(normal) <= 2))
    return (F.size(words) == 0) | normal.isin(generic) | (F.size(content) == 0) | (F.forall(content, lambda t: t.isin(generic)) & (F.size(words) <= 3)) | single


def unsafe(query: Column, patterns: list[str] = UNSAFE) -> Column:
    q = text.strip(F.coalesce(query, F.lit("")))
    return (q == "") | q.rlike("(?i)" + text.EDGE + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")" + text.EDGE)


def off_topic(query: Column) -> Column:
    """No letter or digit; every word longer than 25 or with one character five times in a row; or an instruction to the engine."""
    q = text.strip(F.coalesce(query, F.lit("")))
    words = F.filter(F.split(text.clean(F.regexp_replace(q, rf"[^\p{{L}}\p{{N}}{text.SPACE}]", " ")), " "), lambda w: w != "")
    return (F.size(words) == 0) | F.forall(words, lambda w: (F.length(w) > 25) | w.rlike(r"(.)\1{4,}")) | F.lower(q).rlike(META)


def input_guard(query: Column, compose: bool = False) -> Column:
    """The three guards in order; the first that refuses."""
    return (
        F.when(underspecified(query, compose=compose), verdict(F.lit(True), "INSUFFICIENT_CONTEXT", "underspecified_query"))
        .when(unsafe(query), verdict(F.lit(True), "UNSAFE", "safety_policy_violation"))
        .when(off_topic(query), verdict(F.lit(True), "OFF_TOPIC", "off_topic_query"))
        .otherwise(verdict(F.lit(False), "PASSED", ""))
    )


def question_type(query: Column, hindi_dates: bool = False, compose: bool = False) -> Column:
    """The first type whose pattern is found. hindi_dates: also take Hindi date words, which the ASCII word edge hides."""
    normal = text.normalize(query, compose)
    out = F.lit("GENERAL")
    for name, pattern in reversed(QUESTION_TYPES):
        full = edged(pattern) + (f"|{HINDI_DATE}" if hindi_dates and name == "DATE_TIME" else "")
        out = F.when(normal.rlike(full), name).otherwise(out)
    return out


# Fixed value: capitalised words that do not name anything.
NO_ENTITY = "what where who when why how which is are do does can could should explain tell give state name list define".split()


def entities(query: Column, compounds: list[str] = lexicons.COMPOUND_ENTITIES, singles: list[str] = lexicons.SINGLE_ENTITIES, compose: bool = False) -> Column:
    """Known compounds and single names found in the query, then its capitalised words that no entity before them contains."""
    normal = text.normalize(query, compose)
    known = F.filter(text.literal([*compounds, *singles]), lambda e: F.contains(normal, e))
    raw = F.split(text.strip(F.coalesce(query, F.lit(""))), rf"[{text.SPACE}]+")
    bare = F.transform(raw, lambda w: F.regexp_replace(F.regexp_replace(w, r"(?i)['’]s\z", ""), r"[^\p{L}\p{M}\p{N}]", ""))
    names = F.transform(F.filter(bare, lambda w: (F.length(w) >= 3) & w.rlike("^[A-Z]")), F.lower)
    add = lambda got, e: F.when(e.isin(NO_ENTITY) | F.exists(got, lambda g: F.contains(g, e)), got).otherwise(F.array_append(got, e))
    return F.aggregate(names, F.array_distinct(known), add)


def overlap(part: Column, of: Column) -> Column:
    """The share of part's members, repeats counted, that of has; 0 for none. of is hashed once; part is the short one."""
    missing = F.array_except(part, of)
    return F.when(F.size(part) == 0, F.lit(0.0)).otherwise(F.size(F.filter(part, lambda t: ~F.array_contains(missing, t))) / F.size(part))


def _grams(words: Column, n: int) -> Column:
    count = F.size(words) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))


def _bound(value: Column, use) -> Column:
    """use(value) with value made once: a lambda's variable is not written out again wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def grounding(answer: Column, source: Column, compose: bool = False) -> Column:
    """(passed, confidence): the answer is in the source, or near enough to it in words, content words and word pairs."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    content = lambda ws: F.filter(ws, lambda w: (F.length(w) >= 2) & ~w.isin(lexicons.GROUND_STOP))
    result = lambda ok, conf: F.struct(F.lit(ok).alias("passed"), conf.cast("double").alias("confidence"))

    def judged(x: Column) -> Column:
        # A shared triple has a shared pair in it, so pairs decide.
        near = (x["c"] >= 0.80) & x["pair"]
        return (
            F.when(x["t"] >= 0.85, result(True, x["t"]))
            .when(x["n"] == 0, result(False, x["t"]))
            .when(near & (x["n"] <= 3), result(True, F.least(F.lit(0.98), 0.65 * x["c"] + 0.35 * x["t"])))
            .when(near, result(True, F.least(F.lit(0.98), 0.60 * x["c"] + 0.40 * x["t"])))
            .otherwise(result(False, F.least(F.lit(1.0), 0.55 * x["t"] + 0.45 * x["c"])))
        )

    def measured(x: Column) -> Column:
        ca = content(x["aw"])
        pair = F.arrays_overlap(_grams(x["aw"], 2), _grams(x["sw"], 2))
        return _bound(F.struct(overlap(x["aw"], x["sw"]).alias("t"), overlap(ca, content(x["sw"])).alias("c"), F.size(ca).alias("n"), pair.alias("pair")), judged)

    def compared(x: Column) -> Column:
        split = F.struct(words(x["a"]).alias("aw"), words(x["s"]).alias("sw"))
        return F.when((x["a"] == "") | (x["s"] == ""), result(False, F.lit(0.0))).when(F.contains(x["s"], x["a"]), result(True, F.lit(1.0))).otherwise(_bound(split, measured))

    return _bound(F.struct(text.normalize(answer, compose).alias("a"), text.normalize(source, compose).alias("s")), compared)


def grounded(answer: str, source: str) -> tuple[bool, float]:
    """grounding() of one answer, in Python."""
    a, s = text.py_normalize(answer), text.py_normalize(source)
    if not a or not s:
        return False, 0.0
    if a in s:
        return True, 1.0
    words, there = a.split(), s.split()
    content, held = ([w for w in ws if len(w) >= 2 and w not in lexicons.GROUND_STOP] for ws in (words, there))
    share = lambda xs, ys: sum(x in ys for x in xs) / len(xs) if xs else 0.0
    t, c = share(words, set(there)), share(content, set(held))
    if t >= 0.85 or not content:
        return t >= 0.85, t
    if c >= 0.80 and not set(zip(words, words[1:])).isdisjoint(zip(there, there[1:])):
        return True, min(0.98, 0.65 * c + 0.35 * t if len(content) <= 3 else 0.60 * c + 0.40 * t)
    return False, min(1.0, 0.55 * t + 0.45 * c)
