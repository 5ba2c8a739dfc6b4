"""Text cut off by field limits: pile-ups of lengths expose hidden limits, limits and endings together decide the record.

How it works
------------
1. Each text is read once: its length in seven measures (other encodings, escaping, newlines) and the kind of its ending.
2. Lengths are counted by source and measure, token counts by model. A length that far more different texts have than the
   lengths around it can explain is a hidden limit; its excess share is the prior that a record lying on it was cut.
3. A text that closes properly is whole, whatever its length. All others are judged by a posterior: the prior from the limit
   a record lies on (off all limits: from its source) and the evidence of its ending, whose weight EM learns from the very
   records that lie on limits. Endings that a whole list or phrase may have too carry how often the corpus closes a sentence
   or line after their last words.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.session import ensure_checkpoint_dir

#: Answers that stand for nothing: labels, placeholders of programs, empty marks (fixed values).
PLACEHOLDER = regex.compile(
    r"(?:answer|response|output|trả lời|câu trả lời|đáp án|réponse|回答|答案|none|null|nil|nan|n/a|na|undefined|"
    r"\(?(?:no|empty) (?:output|content|answer|response)\)?|\(?không có nội dung\)?|\(?trống\)?|\(?vide\)?|think)?[\s:：.]*", regex.I)
MARKUP = regex.compile(r"<[^<>]{0,200}>|&(?:[a-z]+|#\d+);|\[E?\d+\]|```\w*|[\p{Cf}\p{Cc}\p{Z}\p{P}\p{S}]+", regex.I)
CITATION = re.compile(r"\[E\d+\](?:\s*,?\s*\[E\d+\])*")
_LAST_CITATION = re.compile(r"(?:\s*,?\s*\[E\d+\])+\s*$")
_LEAD_IN = regex.compile(r"\s*(?:căn cứ|theo|according to|based on|d'après|selon|根据)\s*[,:]?\s*", regex.I)
_OPEN_END = re.compile(r"\[[^\[\]\n]{0,12}$|\([^()\n]{0,60}$|（[^（）\n]{0,60}$")
_HAN = re.compile("[\u3400-\u9fff]")
_TOKEN_HAN = regex.compile(r"\p{Han}|[^\W_\p{Han}]+(?:[.,/%'’\-][^\W_\p{Han}]+)*%?|[^\w\s]|\n")
_TOKEN = re.compile(r"[^\W_]+(?:[.,/%'’\-][^\W_]+)*%?|[^\w\s]|\n")
_LONG_WORD = re.compile(r"[^\W\d_]{2,}")
_GROUP = re.compile(r"(?<![\d/.,:-])\d{1,3}(?:\.\d{3})*\.$")
_BULLET = re.compile(r"\s*(?:[-•*–]|\d+[.)])\s+")
_DIGITS = re.compile(r"\d+")
_ENDS = frozenset(".!?。！？;；:：\n")
_CLOSED = tuple(".!?。！？…\"”»'’)）>}`」』")
#: The measures under which a limit of storage may be hidden, each with the units that cutting a letter or escape can lose.
MEASURES = {"characters": 0, "utf8": 3, "utf16": 1, "crlf": 1, "html": 5, "json": 11, "json_utf8": 3}
#: A length is a limit if its records outnumber the expected ones so many times and with such a log likelihood ratio, where the
#: expected number is taken from so many lengths before and after it. Shorter lengths are no limits.
PILE_TIMES, PILE_RATIO, PILE_SPAN, LEAST_LENGTH = 3.0, 14.0, 24, 64
#: Most rows of a small table that is broadcast (limits by source, last words asked for); beyond it joins and full counts take over.
BROADCAST_ROWS, BROADCAST_WORDS = 10_000, 500_000
#: Kinds of endings to be judged, each with what is believed of them before any data: where the last word stands nowhere else,
#: and by the share of sentence ends after the last words (under 2 %, 10 %, 30 % and above). A belief has the weight of
#: ``BELIEF`` of the kind's own rows and one more.
KINDS = {"torn": (0.99,) * 5, "prose": (0.98,) * 5, "list": (0.95, 0.9, 0.8, 0.3, 0.05), "phrase": (0.7, 0.6, 0.4, 0.15, 0.03), "number": (0.3, 0.6, 0.2, 0.04, 0.01)}
#: What is believed of torn endings and prose is a matter of language and is not learnt.
SURE = ("torn", "prose")
BELIEF, SHARES = 0.05, (0.02, 0.1, 0.3)
#: Levels of priors, and the prior of a record for which more tokens were generated than it can hold.
PRIOR_BINS, EXCESS_PRIOR = 10, 0.8


def has_content(text: str | None) -> bool:
    """False for null, blank, labels, placeholders, marks, empty markup and bare citations."""
    if not text:
        return False
    if len(text) > 60 and "<" not in text[:150] and len(_LONG_WORD.findall(text[:150])) > 12:  # what holds for a part holds for the whole
        return True
    bare = MARKUP.sub(" ", text)
    return not (not bare.strip() or PLACEHOLDER.fullmatch(text.strip()) or PLACEHOLDER.fullmatch(bare.strip()))


def measures(text: str) -> tuple[int, ...]:
    """The length of a text in each of ``MEASURES``; what a cut left of a torn character at the end is not counted."""
    text = text.rstrip("�")
    n, utf8 = len(text), len(text.encode("utf-8", "surrogatepass"))
    wide = n if utf8 == n else len(text.encode("utf-16-le", "surrogatepass")) // 2
    html = n + 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * text.count('"')
    short = sum(map(text.count, "\n\r\t\"\\"))
    return n, utf8, wide, n + text.count("\n") - text.count("\r\n"), html, len(json.dumps(text)) - 2, utf8 + short


def _words(text: str) -> list[str]:
    """Words and marks in lower case, digits as 0, without citations and emphasis."""
    text = _DIGITS.sub("0", CITATION.sub("", text.replace("**", "")).lower())
    return (_TOKEN_HAN if _HAN.search(text) else _TOKEN).findall(text)


_JOIN = "\x1f"


def _gram(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(_JOIN.join(words)) - (1 << 63)


def ending(answer: str | None, question: str | None = None) -> tuple[str, list[str]]:
    """How a text ends: empty, whole, or to be judged - torn, prose, list, number, phrase; and for the last three its last words."""
    if not has_content(answer):
        return "empty", []
    text = answer.rstrip()
    while text.endswith("**") and text.count("**") % 2 == 0:  # emphasis that was opened and closed
        text = text[:-2].rstrip()
    if not text or text.endswith(("’", "'")) and text[-2:-1].isalnum() and not re.search(r"(?:^|\s)[‘']\w", text):  # an apostrophe inside a word
        return "torn", []
    if text.endswith("�") or _OPEN_END.search(text[-80:]):
        return "torn", []
    cited = _LAST_CITATION.search(text) if text.endswith("]") else None
    body = text[: cited.start()].rstrip() if cited else text
    if not body or (cited and _LEAD_IN.fullmatch(body)):
        return "torn", []
    if cited:
        return "whole", []
    if text.endswith(_CLOSED):
        tail = [w for w in _words(text[-200:])[-8:] if w[0].isalnum()][-3:] if _GROUP.search(text[-40:]) else []
        return ("number", tail) if tail else ("whole", [])
    if not (text[-1].isalnum() or text[-1] in "%‰°") and not regex.match(r"\p{M}", text[-1]):
        return "torn", []
    if question:
        asked, said = ([w for w in _words(t) if w[0].isalnum()] for t in (question, text))
        if asked and (said[-5:] == asked[-5:] or len(said) > 4 and not Counter(said) - Counter(asked)):  # gives the question back
            return "whole", []
    lines = [x for x in text.split("\n") if x.strip()]
    items = [x for x in lines if _BULLET.match(x)]
    if len(items) > 1 and lines[-1] == items[-1] and not any(x.rstrip().endswith((*_CLOSED, "]")) for x in items[:-1]):
        return "list", [w for w in _words(_BULLET.sub("", lines[-1])) if w[0].isalnum()][-3:]
    plain = [w for w in _words(text) if w[0].isalnum()] if len(lines) == 1 else []
    return ("phrase", plain) if 0 < len(plain) <= 4 else ("prose", [])


def read_texts(df: DataFrame, columns: dict[str, str | None], also: Callable[[dict[str, list]], list[pa.Array]] | None = None, schema: str = "",
               ) -> DataFrame:
    """One row for each row of ``df``: id, source, model, tokens, the measures, a hash of the text, the kind of its ending and its last words.

    ``columns`` names the columns of ``df`` for id, text, source, model, tokens, question and whatever ``also`` reads; what
    ``also`` returns for a batch is appended under ``schema``, so that the texts are read in one pass.
    """
    picked = df.select(*(F.lit(None).cast("string").alias(k) if c is None else F.col(c).cast("long").alias(k) if k == "tokens" else F.col(c).alias(k)
                         for k, c in columns.items()))
    kept = ", ".join(f"{k} {picked.schema[k].dataType.simpleString()}" for k in ("id", "source", "model", "tokens"))
    every = f"{kept}, {', '.join(f'{m} int' for m in MEASURES)}, h long, ending string, g3 long, g2 long, g1 long, words string" + (f", {schema}" if schema else "")
    names = [part.split()[0] for part in every.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = {k: batch.column(k).to_pylist() for k in columns if k != "id"}
            sizes, hashes, ends = [], [], []
            for text, question in zip(read["text"], read["question"]):
                sizes.append(measures(text) if text else (None,) * len(MEASURES))
                hashes.append(_gram([text]) if text else None)
                kind, last = ending(text, question)
                ends.append((kind, _gram(last[-3:]) if len(last) > 2 else None, _gram(last[-2:]) if len(last) > 1 else None, _gram(last[-1:]) if last else None, _JOIN.join(last[-2:]) if last else None))
            read["ending"] = [e[0] for e in ends]
            by_measure = zip(*sizes) if sizes else ((),) * len(MEASURES)
            parts = zip(*ends) if ends else ((),) * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("id", "source", "model", "tokens")), *(pa.array(x, pa.int32()) for x in by_measure), pa.array(hashes, pa.int64()),
                 *(pa.array(x, t) for x, t in zip(parts, types)), *(also(read) if also else [])], names)

    return picked.mapInArrow(run, every)


def length_limits(texts: DataFrame) -> DataFrame:
    """``source, measure, limit, records, longer, prior``: lengths at which the different texts of a source pile up; of ``read_texts``.

    ``records`` have exactly the limit, ``longer`` exceed it, ``prior`` is the share of the records that the lengths around
    the limit don't explain. A null source is a source of its own; null and empty texts count nowhere, copies of a text once.
    """
    once = texts.where(F.col("h").isNotNull()).dropDuplicates(["source", "h"])
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("length")) for m in MEASURES))
    counts = once.select("source", F.explode(each).alias("m")).groupBy("source", "m.measure", "m.length").agg(F.count("*").alias("records"))
    return _pile_ups(counts, ["source", "measure"])


def token_limits(texts: DataFrame) -> DataFrame:
    """``model, limit, records, longer, prior``: token counts at which the different answers of a model pile up; of ``read_texts``."""
    once = texts.where((F.col("tokens") > 0) & F.col("h").isNotNull()).dropDuplicates(["model", "tokens", "h"])
    return _pile_ups(once.groupBy("model", F.col("tokens").alias("length")).agg(F.count("*").alias("records")), ["model"])


def _pile_ups(counts: DataFrame, by: list[str]) -> DataFrame:
    """Lengths with many more records than the lengths around them explain; ``counts`` has one row per length."""
    line = Window.partitionBy(*by).orderBy("length")
    near = lambda a, b: F.coalesce(F.sum("records").over(line.rangeBetween(a, b)), F.lit(0)) / PILE_SPAN
    after = F.coalesce(F.sum("records").over(line.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    usual = F.greatest(near(-PILE_SPAN, -1), near(8, 7 + PILE_SPAN), F.lit(0.5 / PILE_SPAN))
    r, u = F.col("records"), F.col("_u")
    return counts.select(*by, F.col("length").alias("limit"), "records", usual.alias("_u"), after.alias("longer")).where(
        (F.col("limit") >= LEAST_LENGTH) & (r >= PILE_TIMES * u) & (r * F.log(r / u) - (r - u) >= PILE_RATIO)).withColumn("prior", 1 - u / r).drop("_u")


def ending_statistics(df: DataFrame, text: str, asked: list[str] | None) -> DataFrame:
    """``gram, ends, goes_on``: how often one, two or three words in a row close a sentence or line, or do not.

    Counted over whole texts except their very ends, for the grams that end in one of the ``asked`` last words (joined pairs;
    None: for all); each task sums its batch before the one shuffle.
    """
    wanted = df.sparkSession.sparkContext.broadcast(None if asked is None else (frozenset(asked), frozenset(a.split(_JOIN)[-1] for a in asked)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, lasts = wanted.value or (None, None)
        for batch in batches:
            ends, goes_on = Counter(), Counter()
            for t in batch.column(0).to_pylist():
                w = _words(t)
                for i in range(len(w) - 1):
                    last = w[i]
                    if lasts is None and last[0].isalnum() or lasts is not None and last in lasts:
                        to = ends if w[i + 1] in _ENDS else goes_on
                        to[last] += 1
                        if i and w[i - 1][0].isalnum() and (pairs is None or w[i - 1] + _JOIN + last in pairs):
                            to[w[i - 1] + _JOIN + last] += 1
                            if i > 1 and w[i - 2][0].isalnum():
                                to[_JOIN.join(w[i - 2 : i + 1])] += 1
            keys = list({**ends, **goes_on})
            yield pa.RecordBatch.from_arrays(
                [pa.array([_gram([k]) for k in keys], pa.int64()), pa.array([ends[k] for k in keys], pa.int64()),
                 pa.array([goes_on[k] for k in keys], pa.int64())], ["gram", "ends", "goes_on"])

    parts = df.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(run, "gram long, ends long, goes_on long")
    return parts.groupBy("gram").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))


def _small(df: DataFrame) -> DataFrame:
    """Computed once; broadcast if it has few rows, so that a source of very many records is not sent to one task."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def limit_priors(texts: DataFrame) -> DataFrame:
    """``texts`` with ``on_limit`` and ``on_cap``: the priors of the limit of its source and of its model that a row lies on, or 0."""
    slack = F.create_map(*(F.lit(x) for pair in MEASURES.items() for x in pair))
    limits = _small(length_limits(texts).groupBy("source").agg(
        F.collect_list(F.struct("measure", "limit", (F.col("limit") - slack[F.col("measure")]).alias("least"), "prior")).alias("limits")
    ).withColumnRenamed("source", "limited"))
    caps = _small(token_limits(texts).groupBy("model").agg(F.collect_list(F.struct("limit", "prior")).alias("caps")).withColumnRenamed("model", "capped"))
    own = F.create_map(*(x for m in MEASURES for x in (F.lit(m), F.col(m).cast("long"))))
    best = lambda array, lies: F.coalesce(F.array_max(F.transform(array, lambda x: F.when(lies(x), x["prior"]).otherwise(0.0))), F.lit(0.0))
    joined = texts.join(limits, texts.source.eqNullSafe(limits.limited), "left").join(caps, texts.model.eqNullSafe(caps.capped), "left")
    return joined.withColumns({
        "on_limit": best("limits", lambda x: own[x["measure"]].between(x["least"], x["limit"])), "on_cap": best("caps", lambda x: x["limit"] == F.col("tokens")),
    }).drop("limits", "caps", "limited", "capped")


def posteriors(counts: np.ndarray, prior: np.ndarray, belief: np.ndarray, fixed: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The probability of a cut for each bin of priors (rows) and class of endings (columns), learnt from their counts.

    EM for two kinds of record, cut and whole: each has its own distribution over the endings, the same in all bins, and each
    bin its own share of cuts, which starts at the prior of the limit. Beliefs count as a share of a class's own rows; the
    evidence of the ``fixed`` classes is what is believed of them.
    """
    weight = BELIEF * counts.sum(0) + 1
    cut, whole = weight * belief, weight * (1 - belief)
    share = prior.copy()
    post = np.zeros_like(counts, dtype=float)
    for _ in range(rounds):
        ratio = np.where(fixed, belief / (1 - belief), (cut / cut.sum()) / (whole / whole.sum()))
        odds = (share / (1 - share))[:, None] * ratio
        post = odds / (1 + odds)
        share = ((counts * post).sum(1) + 20 * prior) / (counts.sum(1) + 20)
        cut, whole = (counts * post).sum(0) + weight * belief, (counts * (1 - post)).sum(0) + weight * (1 - belief)
    return post


def judge(df: DataFrame, text: str, texts: DataFrame, limits: bool = True) -> DataFrame:
    """``texts`` (of ``read_texts`` over ``df``) with at_limit, excess and the posterior of a cut, 0 for empty and whole texts.

    ``limits=False`` leaves the limits out, to measure what they are worth.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    texts = texts.checkpoint()
    known = limit_priors(texts)
    if not limits:
        known = known.withColumns({"on_limit": F.lit(0.0), "on_cap": F.lit(0.0)})
    known = known.withColumns({"at_limit": F.greatest("on_limit", "on_cap"),
                               "excess": F.coalesce(F.col("tokens") > 12 + F.col("characters") * 0.7, F.lit(False))})

    unsettled = F.col("ending").isin("list", "number", "phrase")
    judged = F.col("ending").isin(*KINDS)
    found = texts.where(unsettled & F.col("words").isNotNull()).select("words").distinct().limit(BROADCAST_WORDS + 1).toArrow()["words"].to_pylist()
    grams = ending_statistics(df, text, found if len(found) <= BROADCAST_WORDS else None)
    if len(found) > BROADCAST_WORDS:  # the grams that are asked for, by a join
        asked = texts.where(unsettled).select(F.explode(F.array("g3", "g2", "g1")).alias("gram")).distinct()
        grams = grams.join(asked, "gram", "left_semi")
    grams = _small(grams)
    usual = grams.agg((F.sum("ends") + 1) / (F.sum("ends") + F.sum("goes_on") + 20)).first()[0]
    usual = 0.05 if usual is None else float(usual)
    third, second = (grams.select(F.col("gram").alias(g), F.col("ends").alias(f"e{g}"), F.col("goes_on").alias(f"o{g}")) for g in ("g3", "g2"))
    first = grams.select(F.col("gram").alias("g1"), F.lit(True).alias("seen"))
    e3, o3, e2, o2 = (F.coalesce(c, F.lit(0)) for c in ("eg3", "og3", "eg2", "og2"))
    of_two = (e2 + 2 * usual) / (e2 + o2 + 2)  # smoothed towards the usual share, that of three words towards that of two
    share = (e3 + 2 * of_two) / (e3 + o3 + 2)
    level = F.when(F.col("seen"), 1 + sum((share >= F.lit(x)).cast("int") for x in SHARES)).otherwise(0)
    known = known.join(third, "g3", "left").join(second, "g2", "left").join(first, "g1", "left").withColumn(
        "share", F.when(unsettled, level).otherwise(0)).drop("eg3", "og3", "eg2", "og2", "g3", "g2", "g1", "seen", "words", "h")

    # off all limits the prior is that of the source: the share of torn endings and prose among the endings to be judged
    known = known.withColumn("lies", F.when(F.col("at_limit") > 0, "limit").when(F.col("excess"), "excess").otherwise("off")) if limits else known.withColumn("lies", F.lit("off"))
    sure = F.col("ending").isin(*SURE)
    rates = _small(known.where((F.col("lies") == "off") & judged).groupBy("source").agg(F.count_if(sure).alias("_sure"), F.count("*").alias("_all")))
    over = rates.agg((F.sum("_sure") + 1) / (F.sum("_all") + 2)).first()[0]
    rate = (F.col("_sure") + 20 * F.lit(float(over or 0.5))) / (F.col("_all") + 20)
    rates = rates.select(F.col("source").alias("rated"), rate.alias("rate"))
    level = lambda p: F.least(F.floor(p * PRIOR_BINS), F.lit(PRIOR_BINS - 1)).cast("int")
    known = known.join(rates, known.source.eqNullSafe(F.col("rated")), "left").withColumn(
        "bin", F.when(F.col("lies") == "limit", level(F.col("at_limit"))).when(F.col("lies") == "excess", 2 * PRIOR_BINS)
        .otherwise(PRIOR_BINS + level(F.coalesce("rate", F.lit(0.5))))).drop("rate", "rated", "lies")

    classes = [(k, s) for k in KINDS for s in range(len(SHARES) + 2)]
    prior = np.append((np.arange(2 * PRIOR_BINS) % PRIOR_BINS + 0.5) / PRIOR_BINS, EXCESS_PRIOR)
    counts = np.zeros((len(prior), len(classes)))
    for r in known.where(judged).groupBy("bin", "ending", "share").count().collect():  # at most 21 * 25 rows
        counts[r["bin"], classes.index((r["ending"], r["share"]))] += r["count"]
    post = posteriors(counts, prior, np.array([KINDS[k][s] for k, s in classes]), np.array([k in SURE for k, _ in classes]))
    rows = [(b, k, s, float(post[b, i])) for b in range(len(prior)) for i, (k, s) in enumerate(classes)]
    model = spark.createDataFrame(rows, "bin int, ending string, share int, posterior double")
    return known.join(F.broadcast(model), ["bin", "ending", "share"], "left").withColumn("posterior", F.coalesce("posterior", F.lit(0.0)))


def find_truncated(df: DataFrame, id_col: str, text: str, *, source: str, model: str, tokens: str, question: str | None = None,
                   limits: bool = True) -> DataFrame:
    """``id, source, empty, truncated, ending, at_limit, excess, posterior``: one row for each row of ``df``.

    ``truncated``: the text ends inside a word, sentence or mark with a posterior of at least one half. A text that closes
    properly is whole, whatever its length. All others are judged by the hidden limits of their source and model
    (``at_limit``: the record lies on one), by whether more tokens were generated than the text can hold (``excess``) and by
    their ending: a torn character, an open bracket, a comma or bullet; prose without an end mark or a last citation; a bare
    list, a short phrase or a number before a full stop, with what the whole corpus has after the last words. Null, blank and
    placeholder texts are empty, not truncated. Repeated rows and null ids stay; an empty table gives none; other columns
    are ignored.
    """
    texts = read_texts(df, {"id": id_col, "text": text, "source": source, "model": model, "tokens": tokens, "question": question})
    return judge(df, text, texts, limits).select(
        "id", "source", (F.col("ending") == "empty").alias("empty"), (F.col("posterior") >= 0.5).alias("truncated"), "ending",
        (F.col("at_limit") > 0).alias("at_limit"), "excess", F.round("posterior", 6).alias("posterior"))


def hidden_limits(df: DataFrame, source: str, text: str) -> DataFrame:
    """``source, measure, limit, records, longer``: the limits of ``length_limits`` for a table of texts."""
    texts = read_texts(df.withColumn("_none", F.lit(None).cast("string")), {"id": "_none", "text": text, "source": source, "model": "_none", "tokens": "_none", "question": None})
    return length_limits(texts).drop("prior")


def truncation_by_source(found: DataFrame) -> DataFrame:
    """``source, answers, truncated, at_limit, rate``: how often each source truncates its non-empty texts."""
    full = found.where(~F.col("empty"))
    return full.groupBy("source").agg(
        F.count("*").alias("answers"), F.count_if("truncated").alias("truncated"), F.count_if(F.col("truncated") & F.col("at_limit")).alias("at_limit"),
        F.round(F.count_if("truncated") / F.count("*"), 6).alias("rate"))
