"""What is decided about one query and its few candidates: features and scores, coverage, answer sentences.

Candidates of a query are bounded (eight at most reach the reranker), so a query's rows fit one small group. Everything
here is plain Python over such a group; plans.answer brings it to the rows by Arrow.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions import lexicons
from ..functions.text import py_normalize
from .chunking import _sentence
from .guardrails import NO_ENTITY, QUESTION_TYPES

# Cue patterns, tried on normalised text with ASCII word edges.
DEFINITION_QUERY = r"^what is\b|^what are\b|^define\b|क्या है$|क्या हैं$|का अर्थ क्या है|की परिभाषा"
RELATION_QUERY = r"\bwhat does\b|\bwhat do\b|\bhow does\b|\bhow do\b|\bwhat is used for\b|क्या.*ले जाता|क्या.*ले जाती|क्या.*करता|क्या.*करती|कैसे.*करता|कैसे.*करती"
RELATION_NEAR = r"\b(?:carry|carries|carried|transport|transports|transported|move|moves|moved|contain|contains|produce|produces|provide|provides|include|includes)\b|ले जाता|ले जाती|ले जाते|परिवहन|उत्पन्न|स्थानांतरित|\b(?:carry|transport|move|contain|produce|provide|include)\w*\b.*\b(?:water|minerals|sugar|sugars|food|nutrients|products?)\b|\b(?:water|minerals|sugar|sugars|food|nutrients|products?)\b.*\b(?:carry|transport|move|contain|produce|provide|include)\w*\b"
HINDI_COPULA = ["एक", "वह", "कहलाता", "कहलाती", "होता", "होती", "है"]
RELATION_EVIDENCE = r"\bcarry(?:s|ing)?\b|\btransport(?:s|ed|ing)?\b|\bproduce(?:s|d|ing)?\b|\bcontain(?:s|ed|ing)?\b|\binclude(?:s|d|ing)?\b|\bprovide(?:s|d|ing)?\b|\bmove(?:s|d|ing)?\b|\btransfer(?:s|red|ring)?\b|\bflow(?:s|ed|ing)?\b|\bdeliver(?:s|ed|ing)?\b|\btransportation\b|ले जाता|ले जाती|ले जाते|परिवहन|उत्पन्न|स्थानांतरित|प्रवाह|बहता|बहती|बहते|\bproducts?\b|\bsugars?\b|\bwater\b|\bminerals?\b|\bfood\b|\bnutrients?\b|\bphotosynthesis\b|\bpressure flow\b|\bsources?\b|\bsinks?\b|पानी|खनिज|भोजन|शर्करा|चीनी"
DEFINITION_EVIDENCE = r"\bis\s+(?:a|an|the)\b|\bare\s+(?:a|an|the)\b|\bmeaning\s+(?:is|of)\b|\bmeans?\b|\brefers?\s+to\b|\bdefined\s+as\b|\bknown\s+as\b|\bis\s+defined\b|\bdenotes?\b|\bcalled\b|का अर्थ|का मतलब|की परिभाषा|कहलाता|कहलाती|एक प्रक्रिया|एक प्रकार|अर्थात"
EVIDENCE = {
    "WEATHER": (r"\b(?:celsius|fahrenheit|humidity|precipitation|weather forecast|degrees today|temperature today)\b", "temporal_live_data_unavailable"),
    "CAPITAL": (r"\b(?:capital|state capital|panaji|chandigarh|delhi|mumbai|bengaluru|rajdhani|seat of government)\b|राजधानी", "missing_question_intent"),
    "LOCATION": (r"\b(?:located|southwestern|coast|region|situated|bounded|borders|ghats|arabian sea|in the|district|state of)\b|स्थित|तट|कोंकण|स्थान", "missing_question_intent"),
    "FOUNDER": (r"\b(?:founded|established|founder|father|created by|director|headed|scientist|sarabhai)\b|स्थापित|संस्थापक|किसने|बनाया|स्थापना", "missing_question_intent"),
    "DATE_TIME": (r"\b(?:19\d{2}|20\d{2}|year|date|established|founded|launched|liberation)\b", "missing_date_evidence"),
    "NUMERICAL": (r"\b\d+(?:\.\d+)?\b", "missing_numerical_evidence"),
    "EXPLANATION": (r"\b(?:because|therefore|works by|works through|process|mechanism|steps|consists of|uses|allows|enables|first|then|finally)\b", "missing_explanation_evidence"),
}
RELATION_SUBJECT = [
    r"\bwhat\s+does\s+(.+?)\s+(?:carry|transport|produce|contain|do|use|provide|include|refer\s+to|mean)\b",
    r"\bwhat\s+do\s+(.+?)\s+(?:carry|transport|produce|contain|do|use|provide|include)\b",
    r"\bhow\s+does\s+(.+?)\s+work\b",
    r"\bwhat\s+happens\s+to\s+(.+?)\b",
    r"^(.+?)\s+क्या\s+(?:करता|करती|करते|ले जाता|ले जाती|ले जाते|उत्पन्न करता|उत्पन्न करती|उत्पन्न करते)",
]
DEFINITION_SUBJECT = [r"\bmeaning\s+of\s+(.+?)(?:\s+in\s+.+?)?$", r"\bwhat\s+does\s+(.+?)\s+mean(?:\s+in\s+.+?)?$", r"\bwhat\s+(?:is|are)\s+(.+?)$", r"(.+?)\s+(?:क्या है|क्या हैं|की परिभाषा|का अर्थ क्या है|का मतलब क्या है)$"]
INTENTS = [
    ("CAPITAL", r"\bcapital\b"),
    ("LOCATION", r"\b(?:where|location|located|situated|place)\b"),
    ("FOUNDER", r"\b(?:who|founder|founded by|established by|creator|author)\b"),
    ("TIME", r"\b(?:when|year|date|century)\b"),
    ("REASON", r"\b(?:why|reason|purpose|advantage)\b"),
    ("METHOD", r"\b(?:how|algorithm|mechanism|process|works)\b"),
    ("DEFINITION", r"\b(?:what|definition|define|meaning)\b"),
]
RELATION_QUESTION = r"(?:क्या|कौन सा|कौनसी|कौन से).*(?:ले जाता|ले जाती|परिवहन|उत्पन्न|बनाता|बनाती|रखता|रखती|करता|करती)"
TWO_QUESTIONS = r"\b(?:where|who|what|when|why|how|which)\b.*\b(?:and|as well as)\b.*\b(?:where|who|what|when|why|how|which|its|their|is|are|was|were)\b"
SPLIT = r"\b(?:and\s+also|and|as well as|aur)\b"
SENTENCE_DEFINITION = r"\b(?:is a|is an|is the|is defined as|refers to|known as)\b|एक प्रकार|कहलाता|कहलाती|कहलाते|की परिभाषा|का अर्थ|का मतलब"
#: Pairs of subjects that exclude one another: a sentence on one only does not answer a question on the other.
RIVALS = [({"xylem", "जाइलम"}, {"phloem", "फ्लोएम"})]
REFUSAL = "I could not find enough grounded information to answer this question."


@lru_cache(maxsize=4096)
def _compiled(pattern: str) -> re.Pattern:
    # \b and \w of ASCII only, without touching the letters of other scripts that the patterns name.
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return re.compile(pattern.replace(r"\b", edge).replace(r"\w", "[A-Za-z0-9_]"), re.IGNORECASE)


def found(pattern: str, s: str) -> re.Match | None:
    return _compiled(pattern).search(s)


def tokens(s: str, stop: frozenset[str], normal: bool = False) -> list[str]:
    return [w for w in (s if normal else py_normalize(s)).split(" ") if len(w) >= 2 and w not in stop]


RERANK_STOP, EXTRACT_STOP, NEGATION = frozenset(lexicons.RERANK_STOP), frozenset(lexicons.EXTRACT_STOP), frozenset(lexicons.NEGATION)
ACTIONS, GENERIC_SUBJECTS, AUTHORSHIP = frozenset(lexicons.ACTION_WORDS), frozenset(lexicons.GENERIC_SUBJECTS), frozenset(lexicons.AUTHORSHIP)


def stem(w: str) -> str:
    for end, least, put in (("ies", 4, "y"), ("ing", 5, ""), ("ied", 4, "y"), ("ed", 4, ""), ("es", 4, ""), ("s", 3, "")):
        if w.endswith(end) and len(w) > least:
            return w[: -len(end)] + put
    return w


RELATION_STEMS = frozenset(map(stem, lexicons.RELATION_WORDS))


class Evidence:
    """A normalised text, with and without its spaces."""

    def __init__(self, s: str):
        self.normal = py_normalize(s)
        self.flat = self.normal.replace(" ", "")
        self.words = frozenset(self.normal.split(" "))

    def has(self, name: str) -> bool:
        n = py_normalize(name)
        flat = n.replace(" ", "")
        return bool(n) and (n in self.normal or len(flat) >= 2 and flat in self.flat)

    def has_entity(self, e: str) -> bool:
        n = py_normalize(e)
        return self.has(n) or (n.endswith("s") and len(n) > 4 and self.has(n[:-1])) or any(map(self.has, lexicons.ENTITY_ALIASES.get(n, ())))

    def has_token(self, t: str) -> bool:
        n = py_normalize(t)
        if self.has(n) or any(map(self.has, [*lexicons.ENTITY_ALIASES.get(n, ()), *lexicons.EVENT_SYNONYMS.get(n, ())])):
            return True
        return n in AUTHORSHIP and any(a in self.normal for a in AUTHORSHIP)

    def share(self, of: list[str], test) -> float:
        return sum(map(test, of)) / len(of) if of else 0.0


@lru_cache(maxsize=4_000)
def evidence(s: str) -> Evidence:
    return Evidence(s)


class Asked:
    """What can be told of a query by itself."""

    def __init__(self, query: str):
        self.raw, self.normal = query or "", py_normalize(query or "")
        self.tokens = list(dict.fromkeys(tokens(self.normal, RERANK_STOP, True)))
        self.content = [t for t in self.tokens if t not in NEGATION]
        self.subjects = [t for t in self.content if t not in ACTIONS and t not in GENERIC_SUBJECTS]
        self.entities = self._entities()
        self.negated = any(t in NEGATION for t in self.tokens)
        self.definition, self.relation = bool(found(DEFINITION_QUERY, self.normal)), bool(found(RELATION_QUERY, self.normal))
        self.type = next((name for name, p in QUESTION_TYPES if found(p, self.normal)), "GENERAL")
        self.hindi = any("ऀ" <= c <= "ॿ" for c in self.raw)

    def _entities(self) -> list[str]:
        out = list(dict.fromkeys(e for e in [*lexicons.COMPOUND_ENTITIES, *lexicons.SINGLE_ENTITIES] if e in self.normal))
        for w in self.raw.split():
            w = py_normalize(re.sub(r"['’]s$", "", w, flags=re.I)).replace(" ", "") if re.match("[A-Z]", re.sub(r"[\W_]", "", w)) else ""
            if len(w) >= 3 and w not in NO_ENTITY and not any(w in e for e in out):
                out.append(w)
        return out

    def subject(self, patterns: list[str]) -> str:
        for p in patterns:
            m = found(p, re.sub(r"[?.!,]+$", "", self.raw.strip()))
            if m and m[1].strip():
                return re.sub(r"^(?:the|a|an)\s+", "", m[1].strip(), flags=re.I).strip()
        return ""


@dataclass
class Candidate:
    chunk_ord: int
    doc_id: str
    title: str
    text: str
    parent_text: str
    language: str
    strategy: str
    dense: float = 0.0
    bm25: float = 0.0
    rrf: float = 0.0
    final: float = 0.0
    features: dict[str, float] = field(default_factory=dict)


def features(asked: Asked, c: Candidate) -> dict[str, float]:
    e = evidence(f"{c.title} {c.text} {c.parent_text[:1200]}")
    title = frozenset(py_normalize(c.title).split(" "))
    pairs = list(zip(asked.tokens, asked.tokens[1:]))
    phrase = sum(f"{a} {b}" in e.normal for a, b in pairs) / len(pairs) if pairs else 0.8 * (len(asked.tokens) == 1 and asked.tokens[0] in e.words)
    latin, indic = any("a" <= x <= "z" for x in e.normal), any("ऀ" <= x <= "ॿ" for x in e.normal)
    if asked.hindi:
        language = 1.0 if c.language == "hi" else 0.95 if indic else 0.55
    else:
        language = 1.0 if c.language == "en" else 0.95 if latin and not indic else 0.60
    definition = relation = 0.0
    if asked.definition and asked.subjects:
        there = [s for s in asked.subjects if s in e.words]
        told = [s for s in there if found(rf"\b{re.escape(s)}\s+(?:is|are|refers|means)\b", e.normal) or any(f"{s} {h}" in e.normal for h in HINDI_COPULA)]
        definition = min(1.0, (len(told) + 0.45 * (len(there) - len(told))) / len(asked.subjects))
    if asked.relation:
        for s in asked.subjects:
            at = e.normal.find(s)
            if at >= 0 and found(RELATION_NEAR, e.normal[max(0, at - 100) : at + len(s) + 140]):
                relation = 0.95
    denied = any(w in NEGATION for w in e.words)
    return {
        "coverage": e.share(asked.content, lambda t: t in e.words or e.has_token(t)),
        "subject": e.share(asked.subjects, lambda t: t in e.words or e.has_token(t)),
        "entity": e.share(asked.entities, e.has_entity),
        "phrase": phrase,
        "language": language,
        "definition": definition,
        "relation": relation,
        "title": min(0.15, 0.15 * (sum(t in title for t in asked.tokens) / len(asked.tokens) if asked.tokens else 0.0)),
        "negation": 1.0 if not asked.negated or denied else 0.25,
    }


def rerank(asked: Asked, candidates: list[Candidate], top_k: int = 5) -> list[Candidate]:
    """Scores the candidates and orders them: by score, then subject and entity in the whole document, coverage and BM25."""
    # The numbers below are fixed values: weights of the parts, bonuses, penalties and limits of the score.
    most = {k: max([1e-4, *(getattr(c, k) for c in candidates)]) for k in ("dense", "bm25", "rrf")}
    for c in candidates:
        f = c.features = features(asked, c)
        norm = {k: max(0.0, getattr(c, k)) / most[k] for k in most}
        bonus = 0.22 * f["definition"] if asked.definition else 0.35 * f["relation"] if asked.relation else 0.0
        lost = bool(asked.subjects) and f["subject"] == 0
        penalty = 0.45 * lost + 0.30 * (bool(asked.entities) and f["entity"] == 0) + 0.30 * (lost and f["coverage"] < 0.25)
        s = 0.20 * f["coverage"] + 0.28 * f["subject"] + 0.14 * f["entity"] + 0.08 * norm["rrf"] + 0.06 * norm["bm25"] + 0.05 * norm["dense"]
        s += 0.05 * f["phrase"] + 0.05 * f["language"] + bonus + f["title"] + 0.04 * f["negation"] - penalty
        if asked.relation and f["relation"] == 0:
            s = min(s, 0.12)
        if asked.negated and f["negation"] < 0.5:
            s *= 0.55
        if lost and f["coverage"] < 0.25 and f["entity"] == 0:
            s = min(s, 0.04)
        c.final = min(1.0, max(0.0, s))
    scores = Counter(c.final for c in candidates)

    def order(c: Candidate) -> tuple:
        if scores[c.final] == 1:
            return (-c.final,)
        # Not kept by evidence(): whole documents may be long.
        e = Evidence(f"{c.title} {c.text} {c.parent_text}")
        subject = e.share(asked.subjects, lambda t: t in e.words or e.has_token(t))
        return (-c.final, -subject, -e.share(asked.entities, e.has_entity), -c.features["coverage"], -c.bm25)

    return sorted(candidates, key=order)[: max(1, top_k)]


@dataclass
class Verdict:
    passed: bool
    status: str = "PASSED"
    reason: str | None = None
    confidence: float = 0.0
    entity: float = 1.0
    coverage: float = 0.0
    relevance: float = 0.0


def coverage(asked: Asked, best: list[Candidate], least: float = 0.45) -> Verdict:
    """Whether the surviving candidates can answer the query; the first rule that fails decides."""

    def no(reason: str, confidence: float = 0.05, status: str = "INSUFFICIENT_CONTEXT") -> Verdict:
        return Verdict(False, status, reason, confidence, entity, cover, relevance)

    entity, cover, relevance = 1.0, 0.0, min(1.0, max(0.0, best[0].final)) if best else 0.0
    if not best:
        return no("no_retrieval_candidates", 0.0, "NO_CONTEXT")
    each = [f"{c.title} {c.parent_text or c.text}" for c in best]
    e = evidence(" ".join(each))
    if asked.type == "WEATHER" and not found(EVIDENCE["WEATHER"][0], py_normalize(best[0].parent_text or best[0].text)):
        return no("temporal_live_data_unavailable")
    if asked.entities:
        entity = e.share(asked.entities, e.has_entity)
        if entity == 0:
            return no("entity_mismatch")
    cover = e.share(asked.tokens, e.has_token) if asked.tokens else 1.0
    if asked.entities and entity == 1:
        cover = max(cover, 0.60)
    if asked.type == "RELATION":
        subject = asked.subject(RELATION_SUBJECT)
        if not subject or not (e.has_token(subject) or e.has_entity(subject)):
            return no("missing_relation_subject")
        if not any((x := evidence(s)) and (x.has_token(subject) or x.has_entity(subject)) and found(RELATION_EVIDENCE, x.normal) for s in each):
            return no("insufficient_relation_evidence")
    elif len(asked.tokens) <= 2:
        if asked.entities and entity == 1:
            cover = max(cover, 0.75)
        elif cover < 1:
            return no("insufficient_coverage")
    elif cover < min(least, 0.45 if entity == 1 else 0.60):
        return no("insufficient_coverage", 0.10)
    if asked.type == "DEFINITION":
        subject = asked.subject(DEFINITION_SUBJECT)
        told = subject and any(evidence(s).has_token(subject) and found(DEFINITION_EVIDENCE, s) for x in each for s in re.split(r"[.!?।]+", x))
        if not told:
            return no("insufficient_definition_evidence")
    elif asked.type in EVIDENCE and asked.type != "WEATHER" and not found(EVIDENCE[asked.type][0], e.normal):
        return no(EVIDENCE[asked.type][1])
    final = min(0.99, round(0.30 * entity + 0.25 * cover + 0.25 + 0.20 * relevance, 3))
    if final < 0.42 or relevance < 0.18:
        return no("low_retrieval_confidence", final, "LOW_CONFIDENCE")
    return Verdict(True, "PASSED", None, final, entity, cover, relevance)


@dataclass
class Requirement:
    text: str
    intent: str
    content: list[str]
    entities: list[str]

    def __post_init__(self):
        self.subjects = [t for t in self.entities if len(t) >= 2 and t not in EXTRACT_STOP]
        self.stems = [(t, stem(t)) for t in self.content]


def requirements(query: str) -> list[Requirement]:
    """The questions that a query asks, each with its intent."""
    lower, out = query.lower(), []
    clauses = [query]
    if found(TWO_QUESTIONS, lower):
        clauses = [p.strip() for p in _compiled(SPLIT).split(query)]
    elif 0 <= query.find("?") < len(query) - 1:
        clauses = [p.strip() for p in query.split("?")]
    words = py_normalize(query).split(" ")
    for c in [c for c in clauses if len(c) > 2] or [query]:
        normal = py_normalize(c)
        relation = found(r"\bwhat\s+(?:does|do|did)\b|\bhow\s+does\b", normal) and any(w in normal for w in lexicons.RELATION_WORDS) or found(RELATION_QUESTION, normal)
        intent = "RELATION" if relation else next((name for name, p in INTENTS if found(p, c.lower())), "GENERAL")
        out.append(Requirement(c, intent, tokens(c, EXTRACT_STOP), [w for w in words if w]))
    return out


class Sentence:
    """A sentence with what scoring asks of it."""

    __slots__ = ("text", "normal", "words", "joined", "stems", "related", "defines")

    def __init__(self, s: str):
        self.text, self.normal = s, py_normalize(s)
        self.words = frozenset(w for w in self.normal.split(" ") if len(w) >= 2 and w not in EXTRACT_STOP)
        self.joined = " ".join(self.words)
        self.stems = frozenset(map(stem, self.words))
        self.related = not RELATION_STEMS.isdisjoint(self.stems) or any(w in self.normal for w in lexicons.RELATION_WORDS)
        self.defines = bool(found(SENTENCE_DEFINITION, self.normal))

    def matches(self, token: str, token_stem: str) -> bool:
        return token_stem in self.stems or token in self.joined or any(w in token for w in self.words)


@lru_cache(maxsize=2_000)
def sentences_of(passage: str) -> tuple[Sentence, ...]:
    """Kept for the passages met lately, as queries of a batch share them."""
    return tuple(Sentence(s) for s in (x.strip() for x in _sentence.findall(passage)) if len(s) >= 8)


def score_sentence(s: str | Sentence, r: Requirement) -> float:
    """How well a sentence answers one question. Fewer than two content words answer nothing."""
    s = Sentence(s) if isinstance(s, str) else s
    if s.joined.count(" ") < 1 and sum(len(w) >= 2 and w not in EXTRACT_STOP for w in s.normal.split(" ")) < 2:
        return 0.0
    there = any(t in s.normal for t in r.subjects)
    for one, other in RIVALS:
        for mine, theirs in ((one, other), (other, one)):
            if not there and not mine.isdisjoint(r.subjects) and any(t in s.normal for t in theirs):
                return 0.0
    hits = sum(s.matches(t, u) for t, u in r.stems)
    score = 5 * there + 1.2 * hits + 2 * sum(len(t) >= 2 and t in s.normal for t in r.entities)
    if r.intent == "RELATION":
        score += (5 if s.related else -2) - 5 * (not there)
    elif r.intent == "DEFINITION":
        score += 3 * s.defines - 4 * (not there)
    elif r.intent == "GENERAL":
        score += 4 * there + 0.8 * hits
    return max(0.0, score)


@dataclass
class Answer:
    text: str
    source: str
    confidence: float
    coverage: float


def extract(asked: Asked, chunks: list[Candidate], least: float = 2.0, most: int = 4) -> Answer:
    """Sentences of the candidates' passages, the best for each question, in the order of the passages."""
    seen: set[str] = set()
    rows: list[tuple[int, int, Sentence, Candidate]] = []
    for rank, c in enumerate(chunks[:8]):
        for k, s in enumerate(sentences_of(c.parent_text if len(c.parent_text) > len(c.text) else c.text)):
            if s.normal not in seen:
                seen.add(s.normal)
                rows.append((rank, k, s, c))
    content = tokens(asked.raw, EXTRACT_STOP)
    if 1 <= len(content) <= 4 and not any(w in asked.normal for w in ("what", "who", "where", "when", "why", "how", "which", "define", "explain", "क्या", "कौन", "कहाँ", "कब", "क्यों", "कैसे")):
        r = Requirement(asked.raw, "GENERAL", content, asked.normal.split(" "))
        scored = [(score_sentence(s, r) + 0.2 * (rank == 0), -rank, -k, s, c) for rank, k, s, c in rows if all(t in s.normal for t in content) or any(t in s.normal for t in asked.subjects)]
        best = max(scored, key=lambda x: x[:3], default=None)
        if best and best[0] > 0:
            return Answer(best[3].text, best[4].text, min(0.96, max(0.65, best[0] / 10)), 1.0)
    asks, chosen, total = requirements(asked.raw), {}, 0.0
    met = 0
    for r in asks:
        best = None
        for rank, k, s, c in rows:
            score = score_sentence(s, r)
            if not score:
                continue
            score += {0: 0.15, 1: 0.05}.get(rank, 0.0)
            if best is None or score > best[0]:
                best = (score, rank, k, s, c)
        if best and best[0] >= least:
            met += 1
            total += best[0]
            chosen[best[3].normal] = best[1:]
    share = met / len(asks)
    if not chosen or share < 0.5:
        return Answer(REFUSAL, "", 0.1, share)
    picked = sorted(chosen.values(), key=lambda x: x[:2])[:most]
    source = picked[0][3].parent_text or picked[0][3].text
    return Answer(" ".join(x[2].text for x in picked), source, min(0.97, max(0.45, total / (8 * len(asks)) * share)), share)


def settle(verdict: Verdict, answer: Answer, grounded: bool) -> tuple[str, bool, float]:
    """(status, grounded, confidence) of the whole."""
    if answer.coverage < 0.35 or not grounded:
        return "GROUNDING_FAILED", False, 0.5 * answer.confidence
    if answer.coverage >= 1:
        return "PASSED", True, min(0.99, max(0.70, 0.5 * verdict.confidence + 0.5 * answer.confidence))
    return "PASSED", False, min(0.60, answer.confidence * answer.coverage)
