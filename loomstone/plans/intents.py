"""From a question to a plan: rule-based intents, on the driver for one question and as Columns for many."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.scores import col
from loomstone.operators import graph

#: What asks for everything rather than the best few.
EXHAUSTIVE = [
    r"\b(all|every)\s+\w*\s*(that\s+)?(depend|import|use|call)", r"\b(complete|full)\s+(list|set)", r"\bwhat\s+(depends|imports|uses|calls)\s+", r"\bwho\s+(depends|imports|uses|calls)\s+",
    r"\beverything\s+that\s+(depends|imports|uses|calls)", r"\blist\s+(all\s+)?(dependencies|dependents|importers|callers)", r"\bfind\s+(all\s+)?(files|modules)\s+(that\s+)?(depend|import)",
    r"\b(break|affect|impact|change).*\brefactor", r"\brefactor.*\b(break|affect|impact|what\s+would)", r"\b(all|list|every)\b.*\brefactor", r"\brefactor.*\b(all|list|every)\b",
    r"\bbreaking\s+change\s+analysis", r"\bbreaking\s+change.*\b(if|when|would)\b", r"\bwhat\s+breaks\s+if", r"\bimpact\s+analysis", r"\btransitive", r"\bexhaustive", r"\bhow\s+many\b.*\b(depend|import|use|call)", r"\btotal\s+count",
]

#: The edge types that each verb asks for, and each noun, with the way it looks from its object.
VERBS = {"import": ("imports",), "use": ("imports", "calls"), "depend": ("imports", "calls"), "call": ("calls",), "extend": ("extends",), "implement": ("implements",)}
NOUNS = {
    "dependent": ("dependents", ("imports", "calls")),
    "caller": ("dependents", ("calls",)),
    "dependency": ("dependencies", ("imports",)),
    "import": ("dependencies", ("imports",)),
}
ASKERS, THINGS, ARTICLES, JOINERS = {"what", "who", "which"}, {"file", "module", "function", "class"}, {"the", "a", "an"}, {"of", "for", "in"}
REQUESTS = ASKERS | {"show", "list", "find", "get"}
ANY_EDGES = ("imports", "calls")
_TEST = re.compile(r"\b(tests?|specs?|coverage)\b.*\b(for|of|cover)|\bwhich\s+tests?\b", re.I)

#: Words of the other intents.
TOPICS = {
    "call_flow": [r"\bcall\s*(flow|graph|chain)\b", r"\btrace\b", r"\bflow\s+(of|from|through)\b", r"\bexecution\s+path\b"],
    "git": [r"\bcommits?\b", r"\bblame\b", r"\bchanged\b", r"\bhistory\b", r"\bwho\s+(wrote|changed|owns)\b", r"\brecent(ly)?\b"],
    "definition": [r"\bwhere\s+is\b", r"\bdefin(e|ed|ition)\b", r"\bdeclar(e|ed|ation)\b", r"\bsignature\b"],
    "explain": [r"\bhow\s+(does|do|is)\b", r"\bexplain\b", r"\boverview\b", r"\barchitecture\b", r"\bwhy\b"],
}

#: By intent the least similarity, the number of results and the graph depth.
STRATEGY = {"structural": (0.2, 200, 2), "test": (0.25, 50, 1), "call_flow": (0.25, 50, 5), "git": (0.2, 50, 0), "definition": (0.4, 20, 1), "explain": (0.3, 30, 1), "search": (0.3, 20, 1)}


@dataclass
class Intent:
    kind: str
    confidence: float
    direction: str | None = None
    target: str | None = None
    edge_types: tuple[str, ...] = ()
    exhaustive: bool = False
    strategy: tuple[float, int, int] = field(default=(0.3, 20, 1))


def _one(word: str, known) -> str | None:
    """The singular, or the verb without its ending, among the known words."""
    word = word.lower()
    forms = [word, *([word[:-1]] if word.endswith("s") else []), *([word[:-2]] if word.endswith("es") else []), *([word[:-3] + "y"] if word.endswith("ies") else [])]
    return next((f for f in forms if f in known), None)


def _object(words: list[str]) -> str | None:
    """What is asked about: the words without an article before them and quotes around them."""
    words = words[1:] if words and words[0].lower() in ARTICLES else words
    return " ".join(words).strip(" '\"`") or None


def _clause(words: list[str]) -> tuple[str, str | None, tuple[str, ...]] | None:
    """Of what follows an asker: 'does X verb' and 'X verbs' ask for what X needs, 'verb X' for what needs X."""
    if words and _one(words[0], THINGS):
        words = words[1:]
    if words and words[0].lower() == "that":
        words = words[1:]
    if not words:
        return None
    ends = words[:-1] if words[-1].lower() == "on" else words
    verb = _one(ends[-1], VERBS) if ends else None
    if words[0].lower() in ("does", "do"):
        return ("dependencies", _object(ends[1:-1]), VERBS[verb]) if verb and len(ends) > 2 else None
    first = _one(words[0], VERBS)
    if first:
        rest = words[1:]
        if first == "depend":
            rest = rest[1:] if rest and rest[0].lower() == "on" else []
        return ("dependents", _object(rest), VERBS[first]) if rest else None
    return ("dependencies", _object(ends[:-1]), VERBS[verb]) if verb == "import" and len(ends) > 1 else None


def structural_intent(question: str) -> Intent | None:
    """A question taken apart: an asker with a clause, or a noun with its object ('callers of X', "X's dependencies").

    Confidence 0.9, or 0.6 if a verb and a request merely occur: then the target is what is quoted or named like a
    file, if anything is.
    """
    words = question.strip().rstrip("?!. ").split()
    lower = [w.lower() for w in words]
    found = None
    for i, w in enumerate(lower):
        if w in ASKERS or (_one(w, THINGS) and lower[i + 1 : i + 2] == ["that"]):
            found = _clause(words[i + 1 :])
            if found and found[1]:
                return Intent("structural", 0.9, *found)
    for i, w in enumerate(lower):
        noun = _one(w, NOUNS)
        if not noun:
            continue
        direction, edges = NOUNS[noun]
        if noun == "dependency" and i and lower[i - 1] == "reverse":
            direction, edges = "dependents", ANY_EDGES
        target = None
        if lower[i + 1 : i + 2] and lower[i + 1] in JOINERS:
            target = _object(words[i + 2 :])
        elif noun == "dependency" and i == len(words) - 1 and i and words[i - 1].endswith(("'s", "s'")):
            target = words[i - 1].removesuffix("'s").removesuffix("'").strip("'\"`")
        if target:
            return Intent("structural", 0.9, direction, target, edges)
    if set(lower) & set(VERBS) and set(lower) & REQUESTS:
        named = re.search(r"[\"'`]([^\"'`]+)[\"'`]", question) or re.search(r"(\w+\.\w+)", question)
        return Intent("structural", 0.6, "dependents", named[1] if named else None, ANY_EDGES)
    return None


def is_exhaustive(question: str) -> bool:
    return any(re.search(p, question, re.I) for p in EXHAUSTIVE)


def classify(question: str) -> Intent:
    """Structural at .6, test at .7, else the topic with the most matches: min(.95, .5 + .1 n), less 15 % if another is close."""
    found = structural_intent(question)
    if found is None and _TEST.search(question):
        found = Intent("test", 0.8)
    if found is None:
        counts = {k: sum(bool(re.search(p, question, re.I)) for p in ps) for k, ps in TOPICS.items()}
        best = max(counts, key=counts.get)
        if counts[best]:
            second = sorted(counts.values())[-2]
            found = Intent(best, min(0.95, 0.5 + 0.1 * counts[best]) * (0.85 if second >= 0.7 * counts[best] else 1.0))
        else:
            found = Intent("search", 0.5)
    found.exhaustive = is_exhaustive(question)
    found.strategy = STRATEGY[found.kind]
    return found


def exhaustive_column(question) -> Column:
    """The same test for a column of questions."""
    return col(question).rlike("(?i)" + "|".join(f"(?:{p})" for p in EXHAUSTIVE))


def answer(question: str, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(id, depth) of what a structural question asks, over edges (src, dst, kind) and names (id, name); unresolved targets give no rows."""
    intent = classify(question)
    if intent.kind != "structural":
        raise ValueError("not a structural question")
    target = F.lit(intent.target)
    start = names.where((F.col("name") == target) | F.col("name").endswith(F.concat(F.lit("/"), target))).select("id")
    chosen = edges.where(F.col("kind").isin(list(intent.edge_types))).select("src", "dst")
    if intent.direction == "dependents":
        chosen = graph.reverse(chosen)
    return graph.reach(chosen, start, 10 if intent.exhaustive else 1, keep_start=False).select("id", "depth").distinct()
