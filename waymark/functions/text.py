"""Answer matching, reply cleaning and prompts, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Labels that a model may put before its reply; question words and cues.
ANSWER_LABELS = ("answer:", "search query:", "query:", "rewritten query:", "rewritten question:")
PARAPHRASE_LABELS = ("rewritten question:", "rewrite:", "paraphrase:", "question:")
WH = ("who", "what", "when", "where", "which", "how", "why")
CUES = ("and", "both", "or", "than", "same", "also", "older", "younger", "earlier", "later", "first", "more", "less")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ABSTENTIONS = ("not specified", "not mentioned", "no answer", "no information", "not provided", "unknown", "not stated", "cannot")


@F.pandas_udf(StringType())
def nfd(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical decomposition; only for text that isn't known to need none."""
    for t in texts:
        yield t.map(lambda x: unicodedata.normalize("NFD", x), na_action="ignore")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Split at white space of any kind; no empty words."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def tokens(c: Column, decompose: bool = False) -> Column:
    """Runs of letters, digits and marks, or one other visible character; lower case."""
    c = nfd(c) if decompose else c
    return F.transform(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"), F.lit(0)), F.lower)


def _padded(token_array: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(token_array, " "), F.lit(" "))


#: Parts texts and answers while they are one text, as decomposition takes whole columns and stands in no lambda.
_PART = "\x1f"


def _sought(answers: Column) -> Column:
    """Answers as their tokens between spaces; without those that have none."""
    joined = F.transform(answers, lambda a: F.array_join(tokens(a), " "))
    return F.transform(F.filter(joined, lambda a: a != ""), lambda a: F.concat(F.lit(" "), a, F.lit(" ")))


def _decomposed(texts: Sequence[Column], answers: Column, rule) -> Column:
    """rule(texts, answers) of decomposed texts and answers."""
    one = nfd(F.concat_ws(_PART, F.array(*[F.translate(t, _PART, " ") for t in texts]), answers))
    n = len(texts)
    known = texts[0].isNotNull()
    for t in texts[1:]:
        known = known & t.isNotNull()
    return F.when(known, F.get(F.transform(F.array(one), lambda s: rule([F.get(F.split(s, _PART), i) for i in range(n)], F.slice(F.split(s, _PART), n + 1, 1_000_000))), 0))


def has_answer(answers: Column, text: Column, decompose: bool = True) -> Column:
    """Whether some non-empty answer's tokens stand in a row in the text's.  Both are decomposed, so composed and decomposed
    letters are the same; without it texts that are of one form already stay with the JVM."""
    if decompose:
        return _decomposed([text], answers, lambda t, a: has_answer(a, t[0], False))
    within = _padded(tokens(text))
    return F.exists(_sought(answers), lambda a: F.contains(within, a))


def is_yes_no(answers: Column) -> Column:
    kinds = F.array_distinct(F.transform(answers, F.lower))
    return (kinds == F.array(F.lit("yes"))) | (kinds == F.array(F.lit("no")))


def normalize_answer(c: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces."""
    bare = F.translate(F.lower(c), PUNCTUATION, "")
    return F.array_join(words(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " ")), " ")


def exact_match(prediction: Column, answers: Column) -> Column:
    p = normalize_answer(prediction)
    return F.exists(answers, lambda a: normalize_answer(a) == p).cast("double")


def token_f1(prediction: Column, answer: Column) -> Column:
    """F1 of two multisets of words; two empty ones agree."""
    p, g = (words(normalize_answer(x)) for x in (prediction, answer))
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    same = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda n, t: n + F.least(count(p, t), count(g, t)))
    empty = (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(empty, (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * same / (F.size(p) + F.size(g)))


def f1_score(prediction: Column, answers: Column) -> Column:
    return F.array_max(F.transform(answers, lambda a: token_f1(prediction, a)))


def _lines(c: Column) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def _tidy(line: Column, labels: Sequence[str]) -> Column:
    """Without one leading label and any pairs of the same quotes around it."""
    found = "|".join(x.removesuffix(":") for x in labels)
    line = strip(F.regexp_replace(line, rf"(?is)^(?:{found}):", ""))
    # a pair at a time: no more than there are quotes and spaces in front
    n = F.length(F.regexp_extract(line, r"""(?U)^[\s"']*""", 0))
    return F.aggregate(F.sequence(F.lit(0), n), line, lambda own, _: strip(F.regexp_replace(own, r"""(?s)^(["'])(.*)\1$""", "$2")))


def first_line(c: Column, labels: Sequence[str] = ANSWER_LABELS) -> Column:
    """A reply's first line with anything on it, tidied; empty without any."""
    return F.coalesce(_tidy(F.get(_lines(c), 0), labels), F.lit(""))


def final_answer(c: Column) -> Column:
    """What follows the last "answer:" of a reply, or its last line."""
    after = F.regexp_extract(c, r"(?is)^.*answer:(.*)$", 1)
    lines = _lines(c)
    last = F.when(F.size(lines) > 0, _tidy(F.get(lines, F.size(lines) - 1), ANSWER_LABELS)).otherwise("")
    return F.when(c.rlike("(?is)answer:"), first_line(after)).otherwise(last)


def normalized(c: Column, decompose: bool = False) -> Column:
    """The words of a phrasing: tokens of letters and digits alone."""
    return F.array_join(F.filter(tokens(c, decompose), lambda t: t.rlike(r"^[\p{L}\p{N}]+$")), " ")


def leaks_answer(paraphrase: Column, original: Column, answers: Column, decompose: bool = True) -> Column:
    """Whether an answer is in the paraphrase that isn't in the original."""
    if decompose:
        return _decomposed([paraphrase, original], answers, lambda t, a: leaks_answer(t[0], t[1], a, False))
    said, asked = (_padded(tokens(c)) for c in (paraphrase, original))
    return F.exists(_sought(answers), lambda a: F.contains(said, a) & ~F.contains(asked, a))


def rewrite_usable(original: Column, rewrite: Column) -> Column:
    """False for a missing or blank rewrite, or one that differs in case and white space only."""
    flat = lambda c: F.lower(F.array_join(words(c), " "))
    return F.coalesce((flat(rewrite) != "") & (flat(rewrite) != flat(original)), F.lit(False))


def query_features(question: Column) -> dict[str, Column]:
    """What a router can know of a question before any retrieval."""
    w = words(question)
    bare = F.transform(w, lambda x: F.lower(F.regexp_replace(x, r"""^[?,.!"'():;]+|[?,.!"'():;]+$""", "")))
    wh = F.coalesce(F.get(F.filter(bare, lambda x: x.isin(*WH)), 0), F.lit("other"))
    out = {"n_words": F.size(w), "n_capitals": F.size(F.filter(F.slice(w, 2, 1_000_000), lambda x: x.rlike(r"^\p{Lu}"))), "has_digit": question.rlike(r"(?U)\d").cast("int")}
    out |= {f"wh_{x}": (wh == x).cast("int") for x in (*WH, "other")}
    return out | {"n_cues": F.size(F.filter(bare, lambda x: x.isin(*CUES)))}


def passage_text(title: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))


def prompt_passage(text: Column, n: int = 200) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def passage_body(passages: Column) -> Column:
    """Numbered passages (an array of title and text) in rank order."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("Passage "), (i + 1).cast("string"), F.lit(" ("), p["title"], F.lit("): "), p["text"])), "\n\n")


def message(prompt: str, question: Column, passages: Column | None = None, end: str = "") -> Column:
    """A user message: the prompt, the passages if any, the question, and what the reply goes on from."""
    parts = [F.lit(prompt)] + ([passage_body(passages)] if passages is not None else [])
    return F.concat(F.concat_ws("\n\n", *parts), F.lit("\n\nQuestion: "), question, F.lit(end))


# What models are asked.
ANSWER_PROMPT = "Answer the question using the passages below. Reply with the answer only: a short phrase of a few words, with no explanation. If it is a yes/no question, reply yes or no."
REWRITE_PROMPT = "Rewrite this question as a search query that will find Wikipedia passages answering it. Keep every name and detail in the question. Reply with the query only."
FOLLOWUP_PROMPT = "Below are a question and passages retrieved for it. Write one search query that would find the information still missing to answer the question, such as a person, place or work that the passages mention and the question depends on. Reply with the query only."
REASON_PROMPT = "Answer the question using the passages below. Reply in exactly this format:\nReasoning: <at most two short sentences>\nAnswer: <a short phrase of a few words, with no explanation>\nIf it is a yes/no question, the answer is yes or no."
PARAPHRASE_PROMPT = "Paraphrase this question: reword it using different words or sentence structure so that it still asks exactly the same thing. Do not add or remove information and do not include the answer."


def answer_message(question: Column, passages: Column) -> Column:
    return message(ANSWER_PROMPT, question, passages, "\nAnswer:")


def rewrite_message(question: Column) -> Column:
    return message(REWRITE_PROMPT, question)


def followup_message(question: Column, passages: Column) -> Column:
    return message(FOLLOWUP_PROMPT, question, passages, "\nSearch query:")


def reason_message(question: Column, passages: Column) -> Column:
    return message(REASON_PROMPT, question, passages)


def paraphrase_message(question: Column) -> Column:
    return message(PARAPHRASE_PROMPT, question, end="\n\nReply with the rewritten question only.")
