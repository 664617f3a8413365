"""Text measures, tokenising and rule-based labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.scores import Value, col

#: Stop words and synonyms of intent normalisation; endings with the token length beyond which they go.
STOP_WORDS = ["a", "an", "and", "are", "does", "do", "describe", "for", "how", "in", "is", "me", "of", "or", "please", "the", "to", "what"]
SYNONYMS = {
    "authentication": "auth", "authenticate": "auth", "authenticated": "auth", "implementation": "function", "implementations": "function", "method": "function", "methods": "function",
    "routine": "function", "routines": "function", "authn": "auth", "login": "auth", "logins": "auth", "explain": "describe", "explains": "describe",
    "flow": "workflow", "flows": "workflow", "work": "workflow", "works": "workflow",
}
ENDINGS = [("ing", 5), ("ed", 4), ("es", 3), ("s", 3)]


def tokens(text: Value, pattern: str = "[^a-z0-9_]+", least: int = 2) -> Column:
    """Lower-cased pieces between runs of `pattern`, of `least` characters or more."""
    return F.filter(F.split(F.lower(col(text)), pattern), lambda t: F.length(t) >= least)


def distinct_tokens(text: Value, **options) -> Column:
    return F.array_sort(F.array_distinct(tokens(text, **options)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def normalize_intent(text: Value) -> Column:
    """Words by synonym, without endings, of two letters or more, without stop words; distinct, sorted, joined by spaces. If none is left, the trimmed lower-cased text."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9_]+"), 0)
    synonyms = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])

    def bare(w: Column) -> Column:
        out = None
        for ending, longer in ENDINGS:
            test, cut = (F.length(w) > longer) & w.endswith(ending), F.substring(w, F.lit(1), F.length(w) - len(ending))
            out = F.when(test, cut) if out is None else out.when(test, cut)
        return out.otherwise(w)

    stems = F.transform(F.transform(words, lambda w: F.coalesce(synonyms[w], w)), bare)
    kept = F.filter(stems, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))
    return F.when(F.size(kept) > 0, F.array_join(F.array_sort(F.array_distinct(kept)), " ")).otherwise(F.lower(F.trim(col(text))))


def intent_similarity(a: Column, b: Column) -> Column:
    """Of two normalised intents: the greater of Jaccard and Dice."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.greatest(jaccard(x, y), dice(x, y))


def coherence(description: Value, instructions: Value) -> Column:
    """The share of the description's words that the instructions have; 1 for no words."""
    d, i = distinct_tokens(description), distinct_tokens(instructions)
    return F.when(F.size(d) == 0, 1.0).otherwise(F.size(F.array_intersect(d, i)) / F.size(d))


def char_entropy(text: Value) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text. Meant for tokens and lines, not for long documents."""
    chars = F.split(col(text), "")
    n = F.size(chars)
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(col(text)) > 0, F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def estimate_tokens(text: Value, per_token: float = 3.5) -> Column:
    return F.ceil(F.length(col(text)) / per_token).cast("long")


def content_hash(text: Value) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def edge_id(source: Value, target: Value, kind: Value) -> Column:
    """The first 32 hex digits of SHA-256 of source:target:type."""
    return F.substring(F.sha2(F.concat_ws(":", col(source), col(target), col(kind)), 256), 1, 32)


def cache_key(*parts: Value) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


def first_rule(text: Value, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that text matches."""
    out = None
    for pattern, label in rules:
        test = col(text).rlike(pattern)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def rule_counts(text: Value, groups: dict[str, list[str]]) -> dict[str, Column]:
    """How many patterns of each group text matches."""
    return {k: sum((col(text).rlike(p).cast("int") for p in ps[1:]), col(text).rlike(ps[0]).cast("int")) for k, ps in groups.items()}


def path_language(path: Value, languages: dict[str, str], fallback: str = "text") -> Column:
    known = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    return F.coalesce(known[F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))], F.lit(fallback))


#: Labels by pattern of a lower-cased text, first match wins.
COMMIT_RULES = [
    (r"^(fix|bugfix|hotfix)[\s:(]", "bugfix"), (r"^(feat|feature|add)[\s:(]", "feature"), (r"^(refactor|cleanup|clean)[\s:(]", "refactor"), (r"^(test|tests|spec)[\s:(]", "test"),
    (r"^(docs|doc|readme)[\s:(]", "docs"), (r"^(chore|build|ci|deps|bump)[\s:(]", "chore"), (r"^(perf|performance|optimize)[\s:(]", "perf"), (r"^(style|format|lint)[\s:(]", "style"), (r"^(revert)[\s:(]", "revert"),
    (r"\b(fix|bug|issue|resolve|patch)\b", "bugfix"), (r"\b(feat|feature|implement|add|new)\b", "feature"), (r"\b(refactor|restructure|reorganize|simplify)\b", "refactor"),
    (r"\b(test|spec|coverage)\b", "test"), (r"\b(doc|docs|documentation|readme|comment)\b", "docs"),
]
REFLOG_RULES = [(r"^commit:|^commit \(initial\):", "commit"), (r"^rebase", "rebase"), (r"^reset:", "reset"), (r"^merge", "merge"), (r"^checkout:", "checkout"), (r"^cherry-pick", "cherry-pick"), (r"^revert", "revert"), (r"^pull:|fast-forward", "pull")]
CACHE_RULES = [(r"\b(error|exception|bug|failed|failing|timeout|trace|stack)\b|why does", "diagnostic"), (r"\bhow does\b|\barchitecture\b|\bdesign\b|\boverview\b|\bconcept\b", "conceptual")]
DOCUMENT_RULES = [(r"readme", "readme"), (r"changelog|history", "changelog"), (r"/adr/|decision", "adr"), (r"guide|tutorial|how-?to", "guide"), (r"api|reference", "reference")]
SECRET_RULES = [(r"AKIA[0-9A-Z]{16}", "aws_key"), (r"gh[pousr]_[A-Za-z0-9]{36}", "github_token"), (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "jwt"), (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "private_key"), (r"(?i)(password|passwd|pwd)\s*[:=]\s*\S{6,}", "password"), (r"(?i)(secret|token|api[_-]?key)\s*[:=]\s*\S{8,}", "generic_secret")]
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "c": "c", "cpp": "cpp", "cs": "csharp", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "sql": "sql", "sh": "shell"}


def commit_category(message: Value) -> Column:
    """Prefix rules look at the first line, keyword rules at all of the message."""
    low = F.lower(col(message))
    line = F.element_at(F.split(low, "\n"), 1)
    prefix = first_rule(line, COMMIT_RULES[:9], "")
    return F.when(low.isNull(), "other").when(prefix != "", prefix).otherwise(first_rule(low, COMMIT_RULES[9:], "other"))


def reflog_action(message: Value) -> Column:
    return first_rule(F.lower(col(message)), REFLOG_RULES, "other")


def cache_category(intent: Value) -> Column:
    return first_rule(F.lower(col(intent)), CACHE_RULES, "lookup")
