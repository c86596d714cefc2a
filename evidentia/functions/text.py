"""Text columns: normal forms, tokens, hints, evidence families and hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token grammars, stop words and the vocabularies of hints and evidence families.
TOKEN_V1 = r"[A-Za-z][A-Za-z0-9_-]{3,}"
TOKEN_V2 = r"[A-Za-z][A-Za-z0-9_.+@/-]{1,}"
STOPWORDS = (
    "about", "after", "also", "among", "based", "before", "between", "from", "have", "into", "more", "most", "only", "other", "over",
    "show", "shown", "table", "than", "that", "their", "these", "this", "those", "through", "using", "were", "which", "with",
)
CONDITION_HINTS = {
    "dataset": r"dataset|corpus|benchmark|train(?:ing)? set|test set|validation set",
    "model": r"model|encoder|decoder|architecture|parameter(?:s|ization)?",
    "metric": r"metric|accuracy|precision|recall|f[- ]?1|bleu|rouge|auc|pass@\d+",
    "prompt": r"prompt|instruction|template|demonstration|few[- ]shot|zero[- ]shot|\d+[- ]shot",
    "split": r"split|fold|cross[- ]validation|held[- ]out|dev(?:elopment)? set",
    "baseline": r"baseline|comparison|compared with|control group",
    "training": r"train|finetun|pretrain|optimizer|learning rate|batch size|epoch|warmup|weight decay",
    "decoding": r"decod|beam size|temperature|top[- ]?[kp]|sampling|greedy",
    "evaluation": r"evaluat|judge|annotator|significance|confidence interval|seed|average over",
    "constraint": r"unless otherwise|for all experiments|same setting|fair comparison|comparable|limited to|exclude|filter",
}
EVIDENCE_FAMILIES = {
    "dataset": r"dataset|corpus|benchmark|train(?:ing)? set|dev(?:elopment)? set|test set|split|sample|example|annotation|topic|dialogue|chart",
    "model": r"model|architecture|encoder|decoder|transformer|resnet|roberta|gru|cnn|parameter|layer|attention|embedding|classifier|baseline",
    "metric": r"metric|accuracy|precision|recall|f[- ]?score|f1|bleu|pass@1|muc|ceaf|blanc|conll|rnss|rms|rating|agreement",
    "training": r"train|pretrain|finetun|optimizer|adam|learning rate|batch|epoch|step|hyperparameter|grid search|cross-validation|pruning rate|shot|prompt|decod|quantization|gpu|resolution",
    "result": r"result|show|demonstrate|observe|achiev|outperform|improv|decreas|increase|compare|performance|score|gain|best|worse|higher|lower|gap",
    "method": r"method|approach|task|feature|template|objective|procedure|stage|setting|configuration|selection|generation|filtering|evaluation",
}
CONDITION_WORDS = (
    r"dataset|corpus|model|metric|benchmark|prompt|shot|split|baseline|optimizer|learning rate|batch size|epoch|step|hyperparameter|"
    r"accuracy|precision|recall|f[- ]?score|f1|bleu|pass@1|hardware|gpu|pretrain|finetun|training|evaluation"
)
SECTION_WORDS = (
    r"experiment(?:al)?|setup|method|dataset|corpus|evaluation|results?|discussion|analysis|ablation|implementation|training|benchmark|"
    r"performance|appendix|hyperparameter"
)
AUTHOR_WORDS = r"\b(?:university|department|institute|@[\w.-]+|correspondence)\b"
LICENSE_WORDS = r"\b(?:creative commons|apache|mit license|license:|code release)\b"
OUTLINE_TITLES = r"^\s*(?:(?:\d+(?:\.\d+)*)|[A-Z])?[.)]?\s*(?:references?|bibliography|works\s+cited)\s*$"


def whole_words(body: str) -> str:
    """A pattern for one of the alternatives as whole words, in any case."""
    return rf"(?iU)\b(?:{body})\b"


def word_starts(body: str) -> str:
    return rf"(?iU)\b(?:{body})"


def collapse(c: Column) -> Column:
    """White space of any kind as single blanks, none outside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    """Compatibility composition and case folding; null stays null. Blanks are collapsed."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens of four characters or more, tags and stop words left out, first seen first."""
    found = F.regexp_extract_all(F.regexp_replace(c, "<[^>]+>", " "), F.lit(TOKEN_V1), F.lit(0))
    return F.array_except(F.transform(found, F.lower), F.array(*map(F.lit, STOPWORDS)))


def scope_tokens(c: Column) -> Column:
    """Distinct tokens of three characters or more, for text in normal form; tags count as words here."""
    return F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(TOKEN_V2), F.lit(0))), lambda t: F.length(t) > 2)


def hits(c: Column, patterns: dict[str, str]) -> Column:
    """The sorted names of the patterns that match."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(name)) for name, p in sorted(patterns.items())]))


def condition_hints(c: Column) -> Column:
    return hits(c, {k: whole_words(v) for k, v in CONDITION_HINTS.items()})


def family_hits(c: Column) -> Column:
    return hits(c, {k: word_starts(v) for k, v in EVIDENCE_FAMILIES.items()})


def evidence_family(kind: Column) -> Column:
    """The family that an evidence type stands for, by parts of its name; the first rule that applies."""
    k = F.lower(kind)
    has = lambda *parts: k.rlike("|".join(parts))
    return (
        F.when(has("result", "interpretation", "comparison", "ablation"), "result").when(has("dataset", "corpus"), "dataset")
        .when(has("model", "architecture"), "model").when(has("metric", "evaluation_protocol"), "metric")
        .when(has("training", "hyperparameter", "implementation", "comput"), "training").otherwise("method")
    )


def table_reference(text: Column, label: Column) -> Column:
    """Whether a text names the table of this label, as Table or Tab., in any case."""
    suffix = F.trim(F.regexp_replace(label, r"(?i)^table\s*", ""))
    return F.regexp_like(text, F.concat(F.lit(r"(?iU)\b(?:Table|Tab\.)\s*\Q"), suffix, F.lit(r"\E\b")))


def safe_stem(c: Column) -> Column:
    """A name for a file: runs of other characters as one underscore, a hash where nothing is left."""
    stem = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), F.substring(F.sha2(c, 256), 1, 16))


def scope_id(path: Column) -> Column:
    """A stable id of a section path in normal form."""
    return F.concat(F.lit("scope-"), F.substring(F.sha2(F.array_join(path, " > "), 256), 1, 16))


def memory_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 20)


def is_reference_path(path: Column) -> Column:
    """Whether a title of the path is that of a reference list."""
    return F.exists(path, lambda t: t.rlike("(?iU)" + OUTLINE_TITLES))


def share_section(a: Column, b: Column) -> Column:
    """Whether the shorter of two normal paths begins the other; an empty path shares nothing."""
    n = F.least(F.size(a), F.size(b))
    return (n > 0) & (F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))


def least_distance(a: Column, b: Column) -> Column:
    """The least distance between numbers of two arrays; null if one is empty."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y)))))


def clamp_score(c: Column) -> Column:
    """A score between 0 and 1 from text or number; null where it is neither."""
    number = c.try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def as_bool(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "1", "yes", "match", "y")


def without_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def without_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?m)^\s*```[A-Za-z]*\s*$", ""), F.lit(" \n"))


def truncated(c: Column, most: int) -> Column:
    return F.when((F.lit(most) > 0) & (F.length(c) > most), F.concat(F.substring(c, 1, most), F.lit("\n...[TRUNCATED]"))).otherwise(c)
