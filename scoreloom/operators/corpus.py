"""Corpus-level statistics: text overlap, errors, roll-ups over subtasks, log regression (survey rows G24-G27, G32)."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import text as tx
from scoreloom.functions.hashing import hash_unit, poisson_count, stable_hash
from scoreloom.operators.groups import lookup_by_group, ranked, scalar_row, value_buckets
from scoreloom.operators.joins import pos_bucket
from scoreloom.operators.metrics import register_metric


def mean_like(df: DataFrame, name: str, value: str = "value", weight: str = "weight", keys: Sequence[str] = ()) -> DataFrame:
    """mean, perplexity, weighted_perplexity or bits_per_byte of log-likelihoods."""
    v, w = F.col(value), F.col(weight)
    ratio = F.sum(v) / F.sum(w)
    forms = {
        "mean": F.avg(v),
        "perplexity": F.exp(-F.avg(v)),
        "weighted_perplexity": F.exp(-ratio),
        "bits_per_byte": -ratio / F.lit(math.log(2)),
    }
    if name not in forms:
        raise ValueError(f"unknown statistic: {name}")
    return df.groupBy(*keys).agg(forms[name].alias(name))


def middle_element(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Element ``n // 2`` in input order, not in sorted order (G24 ``median``)."""
    out = ranked(df.select(value, pos), [], [F.col(pos)], pos_bucket(pos), "__row")
    n = scalar_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    return out.filter(F.col("__row") - 1 == F.floor(n / 2)).select(F.col(value).alias("median"))


def binary_scores(df: DataFrame, gold: str = "gold", pred: str = "pred", keys: Sequence[str] = ()) -> DataFrame:
    """F1 of the positive class and Matthews correlation from the confusion counts."""
    g, p = F.col(gold) == 1, F.col(pred) == 1
    c = lambda cond: F.sum(cond.cast("long")).cast("double")
    out = df.groupBy(*keys).agg(c(g & p).alias("tp"), c(~g & p).alias("fp"), c(g & ~p).alias("fn"), c(~g & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.coalesce(F.try_divide(tp * tn - fp * fn, root), F.lit(0.0))
    return out.select(*keys, f1.alias("f1"), mcc.alias("mcc"))


def brier(df: DataFrame, gold: str = "gold", probs: str = "probs", keys: Sequence[str] = ()) -> DataFrame:
    """Mean squared distance of class probabilities from the one-hot gold."""
    err = F.aggregate(
        F.transform(F.col(probs), lambda p, i: F.pow(p - F.when(i == F.col(gold), 1.0).otherwise(0.0), F.lit(2.0))),
        F.lit(0.0), lambda a, x: a + x)
    return df.groupBy(*keys).agg(F.avg(err).alias("brier_score"))


def ngrams(tokens: Column, n: int) -> Column:
    k = F.size(tokens) - n + 1
    return F.when(k >= 1, F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(
        F.array().cast("array<string>"))


def caption_tokens(df: DataFrame, pred: str, refs: str, iou: str | None = None, min_iou: float = 0.5) -> DataFrame:
    """Predictions and references in the caption form; a prediction is blanked when its box overlaps too little."""
    p = F.col(pred)
    if iou:
        p = F.when(F.col(iou) >= min_iou, p).otherwise(F.lit(""))

    def form(x: Column) -> Column:
        return F.concat(F.lit("sos "), F.lower(F.replace(F.replace(x, F.lit("."), F.lit(" . ")), F.lit(","), F.lit(" , "))), F.lit(" eos"))

    return df.withColumn("hyp", form(p)).withColumn("ref_list", F.transform(F.col(refs), form))


#: Characters of predictions in one task of :func:`_by_id`, and n-grams that are tallied before they leave it.
TASK_CHARS, TALLY = 1 << 21, 1 << 17


def _counted(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[object, dict[tuple[int, str], list[int]]]]:
    """(id, counts of its n-grams per text) of sorted rows (id, texts as words); rows of one id are added up text by text."""
    grams, last = None, None
    for batch in batches:
        for name, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if grams is None or name != last:
                if grams is not None:
                    yield last, grams
                grams, last = {}, name
            for side, words in enumerate(texts):
                for k in range(1, n + 1):
                    for i in range(len(words or ()) - k + 1):
                        own = grams.setdefault((k, " ".join(words[i : i + k])), [])
                        if len(own) <= side:
                            own.extend([0] * (side + 1 - len(own)))
                        own[side] += 1
    if grams is not None:
        yield last, grams


def _gram_tally(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Number of ids with each n-gram, and with it in a reference, added up over some ids at a time."""
    tally: dict[tuple[int, str], list[int]] = {}

    def made() -> pa.RecordBatch:
        columns = [[k for k, _ in tally], [g for _, g in tally], [v[0] for v in tally.values()], [v[1] for v in tally.values()]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int32(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["k", "gram", "ids", "df"])

    for _, grams in _counted(batches, n):
        for key, c in grams.items():
            own = tally.setdefault(key, [0, 0])
            own[0] += 1
            own[1] += any(c[1:])
        if len(tally) >= TALLY:
            yield made()
            tally = {}
    if tally:
        yield made()


def _by_id(df: DataFrame, id_col: str, hyp: str, refs: str) -> tuple[DataFrame, int]:
    """Rows (id, texts as words), rows of an id next to each other, in tasks whose size does not grow with the table, and the number of tasks."""
    texts = F.transform(F.concat(F.array(F.col(hyp)), F.col(refs)), tx.words)
    chars = df.agg(F.sum(F.length(hyp))).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))
    dealt = df.select(F.col(id_col).alias("id"), hyp, refs).repartition(parts, "id").sortWithinPartitions("id")
    return dealt.select("id", texts.alias("texts")), parts


def text_frequency(df: DataFrame, id_col: str, n: int = 4, hyp: str = "hyp", refs: str = "ref_list") -> DataFrame:
    """For every n-gram the number of ids that have it (``ids``), and that have it in a reference (``df``).

    Tasks add up n-grams before these leave them; the rest is dealt over as many tasks, so that none holds more of them as the table grows.
    """
    rows, parts = _by_id(df, id_col, hyp, refs)
    tally = rows.mapInArrow(lambda it: _gram_tally(it, n), "k int, gram string, ids long, df long")
    return tally.repartition(parts, "k", "gram").groupBy("k", "gram").agg(F.sum("ids").alias("ids"), F.sum("df").alias("df"))


def document_frequency(df: DataFrame, id_col: str, n: int = 4, hyp: str = "hyp", refs: str = "ref_list") -> DataFrame:
    """Number of ids whose references contain each n-gram."""
    return text_frequency(df, id_col, n, hyp, refs).filter("df > 0").select("k", "gram", "df")


#: Rows whose n-grams are counted at a time.
MATCH_ROWS = 256


def match_numbers(hyps: Sequence, refs: Sequence, orders: int, characters: bool) -> np.ndarray:
    """For every row and order the n-grams of the text, of its references together, and those found in both: (rows, 3 * orders).

    An n-gram is one whole number: its row, then its units, most significant first. Where the bits run out the numbers so far are replaced by their ranks.
    """
    known: dict[str, int] = {}

    def units(text: str | None) -> np.ndarray:
        words = (text or "").split()
        if characters:
            return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return np.array([known.setdefault(w, len(known)) for w in words], np.uint64)

    texts = [(row, side, units(t)) for row, (h, rs) in enumerate(zip(hyps, refs, strict=True)) for side, t in enumerate([h, *rs])]
    rows, sides, sizes = (np.array(x, np.int64) for x in zip(*[(r, s, len(u)) for r, s, u in texts], strict=True))
    alphabet, unit = np.unique(np.concatenate([u for *_, u in texts]), return_inverse=True)
    unit, unit_bits = unit.astype(np.uint64), int(len(alphabet)).bit_length()
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(unit))
    side, at = np.repeat(sides, sizes), np.arange(len(unit))
    code, bits = np.repeat(rows, sizes).astype(np.uint64), int(len(hyps)).bit_length()
    # The least number a row's n-grams can have; numbers of later rows are larger.
    base, out = np.arange(len(hyps) + 1).astype(np.uint64), np.zeros((len(hyps), 3 * orders), np.int64)
    for k in range(1, orders + 1):
        fits = left[at] >= k
        at, code = at[fits], code[fits]
        if bits + unit_bits > 64:
            ranks, code = np.unique(code, return_inverse=True)
            base, code, bits = np.searchsorted(ranks, base).astype(np.uint64), code.astype(np.uint64), int(len(ranks)).bit_length()
        code = (code << np.uint64(unit_bits)) | unit[at + k - 1]
        base, bits = base << np.uint64(unit_bits), bits + unit_bits
        own, counts = np.unique(code[side[at] == 0], return_counts=True)
        caps = np.zeros(len(own), np.int64)
        for s in range(1, int(sides.max()) + 1):
            other, n = np.unique(code[side[at] == s], return_counts=True)
            if len(other):
                place = np.minimum(np.searchsorted(other, own), len(other) - 1)
                np.maximum(caps, np.where(other[place] == own, n[place], 0), out=caps)
        found = np.append(0, np.cumsum(np.minimum(counts, caps)))
        ends = np.searchsorted(own, base)
        grams = np.maximum(sizes - k + 1, 0)
        out[:, 3 * k - 3] = grams[sides == 0]
        out[:, 3 * k - 2] = np.bincount(rows[sides > 0], grams[sides > 0], len(hyps))
        out[:, 3 * k - 1] = found[ends[1:]] - found[ends[:-1]]
    return out


def _matches(orders: int, characters: bool):
    """Arrow batch function: :func:`match_numbers` of every row as an array. A text's count of an n-gram is clipped by the largest count in any one
    reference. Nothing but these numbers leaves a row."""

    @F.pandas_udf("array<bigint>")
    def of(hyp: pd.Series, refs: pd.Series) -> pd.Series:
        parts = [match_numbers(hyp[i : i + MATCH_ROWS], refs[i : i + MATCH_ROWS], orders, characters) for i in range(0, len(hyp), MATCH_ROWS)]
        return pd.Series([row for part in parts for row in part])

    return of


def corpus_bleu(df: DataFrame, id_col: str, n: int = 4, hyp: str = "hyp", refs: str = "ref_list") -> DataFrame:
    """Corpus BLEU-1 .. BLEU-n from summed clipped matches and the closest reference lengths (G25); one pass, one global sum."""
    counted = df.withColumn("__m", _matches(n, False)(F.col(hyp), F.col(refs)))
    size = F.size(tx.words(F.col(hyp)))
    gaps = F.array_min(F.transform(F.col(refs), lambda r: F.struct(
        F.abs(F.size(tx.words(r)) - size).alias("d"), F.size(tx.words(r)).alias("l"))))
    out = counted.agg(
        F.sum(size).alias("t"), F.sum(gaps["l"]).alias("r"),
        *[F.sum(F.greatest(size - (k - 1), F.lit(0))).alias(f"g{k}") for k in range(1, n + 1)],
        *[F.coalesce(F.sum(F.col("__m")[3 * k - 1]), F.lit(0)).alias(f"c{k}") for k in range(1, n + 1)],
    )
    small, tiny = 1e-9, 1e-15
    ratio = (F.col("t") + tiny) / (F.col("r") + small)
    brevity = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(F.lit(1.0))
    cols, product = [], F.lit(1.0)
    for k in range(1, n + 1):
        product = product * (F.col(f"c{k}") + tiny) / (F.col(f"g{k}") + small)
        cols.append((F.pow(product, F.lit(1.0 / k)) * brevity).alias(f"bleu_{k}"))
    return out.select(*cols)


def corpus_chrf(df: DataFrame, id_col: str, order: int = 6, beta: float = 2.0, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Corpus chrF from summed character n-gram matches, averaged over the effective orders (G25); one pass, one global sum."""
    counted = df.select(_matches(order, True)(F.col(hyp), F.array(F.col(ref))).alias("m"))
    sums = counted.agg(*[F.sum(F.col("m")[i]).alias(f"s{i}") for i in range(3 * order)])
    per = sums.select(F.inline(F.array(*[
        F.struct(F.col(f"s{3 * k}").alias("h"), F.col(f"s{3 * k + 1}").alias("r"), F.col(f"s{3 * k + 2}").alias("m")) for k in range(order)
    ]))).filter((F.col("h") > 0) & (F.col("r") > 0))
    pr = per.agg(F.avg(F.col("m") / F.col("h")).alias("p"), F.avg(F.col("m") / F.col("r")).alias("q"))
    b = beta * beta
    score = F.try_divide(F.lit(1 + b) * F.col("p") * F.col("q"), F.lit(b) * F.col("p") + F.col("q"))
    return pr.select((F.coalesce(score, F.lit(0.0)) * 100).alias("chrf"))


#: Characters of predictions and references in one part of :func:`cider`.
PART_CHARS = 1 << 21


def _runs(words: Sequence[str] | None, k: int) -> Iterator[str]:
    """The ``k``-grams of a text, repeats included."""
    return map(" ".join, zip(*((words or ())[i:] for i in range(k)), strict=False))


def _ids(table: pa.Table) -> Iterator[tuple[list[int], Iterator[list]]]:
    """(row numbers, texts of every row as words) of every id of a part."""
    rows: dict[object, list[int]] = {}
    for at, name in enumerate(table["id"].to_pylist()):
        rows.setdefault(name, []).append(at)
    texts = table["texts"]
    for own in rows.values():
        yield own, (texts[i].as_py() for i in own)


def _dealt(table: pa.Table, n: int, parts: int) -> tuple[dict[str, int], dict[int, list[str]]]:
    """The n-grams of a part with the number of ids that have them in a reference, and their sorted lists by the place where they are added up."""
    tally: dict[str, int] = {}
    for _, rows in _ids(table):
        hyps, refs = set(), set()
        for hyp, *others in rows:
            for k in range(1, n + 1):
                hyps.update(_runs(hyp, k))
                for x in others:
                    refs.update(_runs(x, k))
        for gram in refs:
            tally[gram] = tally.get(gram, 0) + 1
        for gram in hyps - refs:
            tally.setdefault(gram, 0)
    lists: dict[int, list[str]] = {}
    for gram in sorted(tally):
        lists.setdefault(zlib.crc32(gram.encode()) % parts, []).append(gram)
    return tally, lists


def _part_grams(table: pa.Table, n: int, parts: int) -> pa.Table:
    """One row per place: the part's n-grams that belong there, one a line, packed, and their document frequencies inside the part."""
    tally, lists = _dealt(table, n, parts)
    return pa.table({
        "place": pa.array(lists, pa.int32()), "part": pa.array([table["part"][0].as_py()] * len(lists), pa.int32()),
        "grams": pa.array([zlib.compress("\n".join(x).encode(), 1) for x in lists.values()], pa.binary()),
        "df": pa.array([[tally[g] for g in x] for x in lists.values()], pa.list_(pa.int64())),
    })


def _place_sums(table: pa.Table) -> pa.Table:
    """The rows of a place with the frequencies of all parts together, in the order of their n-grams, which stay behind."""
    total: dict[str, int] = {}
    lists = [zlib.decompress(x).decode().split("\n") for x in table["grams"].to_pylist()]
    for grams, df in zip(lists, table["df"].to_pylist(), strict=True):
        for g, x in zip(grams, df, strict=True):
            total[g] = total.get(g, 0) + x
    sums = pa.array([[total[g] for g in grams] for grams in lists], pa.list_(pa.int64()))
    return pa.table({"part": table["part"], "place": table["place"], "df": sums})


def _similarity(sides: Sequence[Sequence[Counter]], idf: dict[str, float], sigma: float) -> float:
    """Sum over references and orders of the clipped tf-idf cosine with the length penalty, from counts per text and order."""
    sizes = [counts[1].total() if len(counts) > 1 else 0 for counts in sides]
    weights = [[{g: c * idf[g] for g, c in one.items()} for one in counts] for counts in sides]
    norms = [[math.sqrt(sum(w * w for w in one.values())) for one in own] for own in weights]
    out = 0.0
    for p in range(1, len(sides)):
        penalty = math.exp(-((sizes[0] - sizes[p]) ** 2) / (2 * sigma * sigma))
        for h, r, hn, rn in zip(weights[0], weights[p], norms[0], norms[p], strict=True):
            dot = sum(min(h[g], w) * w for g, w in r.items() if g in h)
            out += (dot / (hn * rn) if hn and rn else dot) * penalty
    return out


def _part_scores(table: pa.Table, sums: pa.Table, n: int, sigma: float, parts: int, rows: int, name: str) -> pa.Table:
    """CIDEr of the ids of a part from the frequencies that came back for its n-grams."""
    _, lists = _dealt(table, n, parts)
    logn, idf = math.log(rows), {}
    for place, df in zip(sums["place"].to_pylist(), sums["df"].to_pylist(), strict=True):
        idf.update((g, logn - math.log(max(x, 1))) for g, x in zip(lists.pop(place), df, strict=True))
    firsts, scores = [], []
    for own, each in _ids(table):
        sides: list[list[Counter]] = []
        for texts in each:
            sides.extend([Counter() for _ in range(n)] for _ in range(len(texts) - len(sides)))
            for counts, words in zip(sides, texts, strict=False):
                for k, one in enumerate(counts, 1):
                    one.update(_runs(words, k))
        firsts.append(own[0])
        named, refs = table["id"][own[0]].is_valid, len(sides) - 1
        scores.append((_similarity(sides, idf, sigma) if named else 0.0) * len(own) / n / refs * 10.0 if refs else None)
    return pa.table({name: table["id"].take(pa.array(firsts, pa.int64())), "cider": pa.array(scores, pa.float64())})


def cider(df: DataFrame, id_col: str, n: int = 4, sigma: float = 6.0, hyp: str = "hyp", refs: str = "ref_list") -> DataFrame:
    """CIDEr per id (G25): tf-idf weighted n-gram cosine against each reference with a length penalty. Rows of one id count as one text, as often as
    they are; an id without references has none.

    Ids are dealt to parts of bounded size. A part sends each of its n-grams once, whatever the number of its ids and texts that have it, to the
    place where its frequencies are added up; only numbers come back, and the part, read again, scores its ids. An n-gram without text, id or
    count crosses the network twice at most, so disk does not grow with the rows that share one.
    """
    own_refs = F.coalesce(F.col(refs), F.array().cast("array<string>"))
    length = F.coalesce(F.length(hyp), F.lit(0)) + F.aggregate(own_refs, F.lit(0), lambda a, x: a + F.coalesce(F.length(x), F.lit(0)))
    size = df.agg(F.sum(length).alias("chars"), F.count(F.lit(1)).alias("rows")).first()
    chars, rows = size["chars"] or 0, size["rows"]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    part = F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")
    dealt = df.select(part.alias("part"), F.col(id_col).alias("id"), F.col(hyp).alias("h"), own_refs.alias("r")).repartitionById(parts, "part")
    texts = dealt.select("part", "id", F.transform(F.concat(F.array("h"), "r"), tx.words).alias("texts")).groupBy("part")
    sent = texts.applyInArrow(lambda t: _part_grams(t, n, parts), "place int, part int, grams binary, df array<long>")
    sums = sent.repartitionById(parts, "place").groupBy("place").applyInArrow(_place_sums, "part int, place int, df array<long>")
    back = sums.repartitionById(parts, "part").groupBy("part")
    kind = df.schema[id_col].dataType.simpleString()
    return texts.cogroup(back).applyInArrow(lambda t, s: _part_scores(t, s, n, sigma, parts, rows, id_col), f"`{id_col}` {kind}, cider double")


def rouge_l(hyp: Column, refs: Column, beta: float = 1.2) -> Column:
    """ROUGE-L against the best reference (G25). The longest common subsequence has no built-in form, hence an Arrow batch UDF."""

    @F.pandas_udf("double")
    def score(h: pd.Series, r: pd.Series) -> pd.Series:
        def lcs(a: list[str], b: list[str]) -> int:
            codes = {w: i for i, w in enumerate(dict.fromkeys(b))}
            bb = np.array([codes[w] for w in b])
            row = np.zeros(len(b) + 1, dtype=np.int64)
            for w in a:
                code = codes.get(w)
                if code is None:
                    continue
                match = np.where(bb == code, row[:-1] + 1, 0)
                row[1:] = np.maximum.accumulate(np.maximum(match, row[1:]))
            return int(row[-1])

        def one(text: str, references) -> float:
            c = text.split(" ")
            common = [(lcs(x, c), len(x)) for x in (t.split(" ") for t in references)]
            pairs = [(n / len(c), n / m) for n, m in common]
            p, q = max(v[0] for v in pairs), max(v[1] for v in pairs)
            return (1 + beta**2) * p * q / (q + beta**2 * p) if p and q else 0.0

        return pd.Series([one(a, b) for a, b in zip(h, r)])

    return score(hyp, refs)


def stderr(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Standard error of the mean."""
    v = F.col(value)
    return df.groupBy(*keys).agg((F.stddev_samp(v) / F.sqrt(F.count(v))).alias("stderr"))


def _poisson_draws(replicates: int, seed: int):
    """Arrow batch function: the Poisson(1) counts of an id for all replicates, those of ``poisson_count(hash_unit(stable_hash(id, replicate)))``.

    The replicates of an id share the state of their common prefix, and all counts of a batch are read off the distribution at once.
    """
    totals, mass = [], math.exp(-1)
    for k in range(1, 19):
        totals.append((totals[-1] if totals else 0.0) + mass)
        mass /= k
    steps, ends = np.array(totals), [str(r).encode() for r in range(1, replicates + 1)]

    @F.pandas_udf("array<int>")
    def of(ids: pd.Series) -> pd.Series:
        heads = []
        for i in ids:
            prefix = hashlib.md5(f"{seed}/".encode() if i is None else f"{seed}/{i}/".encode(), usedforsecurity=False)
            for end in ends:
                one = prefix.copy()
                one.update(end)
                heads.append(b"\0\0" + one.digest()[:6])
        units = np.frombuffer(b"".join(heads), ">u8").astype(np.float64) / float(1 << 48)
        return pd.Series(list(np.searchsorted(steps, units, side="right").astype(np.int32).reshape(-1, replicates)))

    return of


def bootstrap_stderr(
    df: DataFrame, id_col: str, statistic: Callable[[Column], Column], replicates: int = 100, seed: int = 0, keys: Sequence[str] = ()
) -> DataFrame:
    """Bootstrap standard error (G26) of any statistic written as weighted aggregates.

    Every row gets a Poisson(1) count per replicate from a hash, which is the bootstrap for large tables without moving rows;
    ``statistic`` maps the count column to an aggregate.
    """
    names = [f"__s{r}" for r in range(1, replicates + 1)]
    drawn = _poisson_draws(replicates, seed)(F.col(id_col).cast("string"))
    # All replicates are aggregates of one pass: a task gives one row per key, whatever their number.
    each = [statistic(F.get("__counts", F.lit(r))).alias(name) for r, name in enumerate(names)]
    per = df.withColumn("__counts", drawn).groupBy(*keys).agg(*each)
    return per.select(*keys, F.explode(F.array(*names)).alias("__s")).groupBy(*keys).agg(F.stddev_samp("__s").alias("stderr"))


def pooled_stderr(subtasks: DataFrame, se: str = "stderr", size: str = "size", keys: Sequence[str] = ()) -> DataFrame:
    """Pooled standard error over subtasks."""
    s, n = F.col(se), F.col(size)
    total, k = F.sum(n), F.count(F.lit(1))
    var = F.sum((n - 1) * s * s * n) / (total - k)
    return subtasks.groupBy(*keys).agg(F.sqrt(var / total).alias("pooled_stderr"))


def combined_stderr(
    subtasks: DataFrame, metric: str = "metric", se: str = "stderr", size: str = "size", order: str = "pos", keys: Sequence[str] = ()
) -> DataFrame:
    """Pairwise combined standard error in subtask order.

    The running size stays at the first subtask's size, as the published numbers were computed that way. One row per
    subtask, so the ordered fold is over a short array.
    """
    entry = F.struct(F.col(order).alias("o"), F.col(metric).cast("double").alias("m"), F.col(se).cast("double").alias("s"), F.col(size).cast("double").alias("n"))
    listed = subtasks.groupBy(*keys).agg(F.array_sort(F.collect_list(entry), lambda a, b: (a["o"] - b["o"]).cast("int")).alias("l"))
    first = F.get("l", F.lit(0))
    start = F.struct((first["s"] * first["s"]).alias("v"), first["m"].alias("m"))
    n0 = first["n"]

    def step(acc: Column, e: Column) -> Column:
        n = e["n"]
        mean = (acc["m"] * n0 + e["m"] * n) / (n0 + n)
        var = ((n0 - 1) * acc["v"] + (n - 1) * e["s"] * e["s"]) / (n0 + n - 1) + n0 * n / ((n0 + n) * (n0 + n - 1)) * F.pow(mean - e["m"], F.lit(2.0))
        return F.struct(var.alias("v"), mean.alias("m"))

    rest = F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))
    return listed.select(*keys, F.sqrt(F.aggregate(rest, start, step)["v"]).alias("combined_stderr"))


def flatten_tree(tree: dict, parents: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(group, task) edges of a nested group tree: ``{group: {subgroup: {...}, task: None}}``."""
    edges = []
    for name, below in tree.items():
        if below is None:
            edges += [(p, name) for p in parents]
        else:
            edges += flatten_tree(below, (*parents, name))
    return edges


def group_metrics(
    results: DataFrame, tree: dict, weight_by_size: bool = True, task: str = "task", metric: str = "metric", value: str = "value",
    size: str = "size", se: str | None = None,
) -> DataFrame:
    """Metrics of every group in a nested tree (G27): size-weighted or plain means over its subtasks, sizes summed."""
    edges = flatten_tree(tree)
    groups = F.array(*[F.when(F.col(task) == t, F.lit(g)) for g, t in edges])
    rows = results.withColumn("group", F.explode(F.filter(groups, lambda g: g.isNotNull())))
    w = F.col(size) if weight_by_size else F.lit(1)
    aggs = [(F.sum(F.col(value) * w) / F.sum(w)).alias("value"), F.sum(size).alias("samples")]
    if se:
        s, n = F.col(se), F.col(size)
        aggs.append(F.sqrt(F.sum((n - 1) * s * s * n) / (F.sum(n) - F.count(F.lit(1))) / F.sum(n)).alias("stderr"))
    return rows.groupBy("group", metric).agg(*aggs)


# Keys of a training step log line.
STEP_KEY = r"step:(\d+) - "
NUMBER_VALUE = r"([0-9.eE+-]+)"


def parse_step_log(lines: DataFrame, metric: str, share: str, extra: dict[str, str] | None = None, line: str = "value") -> DataFrame:
    """Steps of a text log (G32): ``metric`` value, ``share`` entries as an array of (key, x), further values by name.

    ``share`` contains one capture for the key, such as ``views/(\\d+)/frac``. Lines without step, metric or shares are
    dropped; the last line of a step wins.
    """
    text = F.col(line)
    get = lambda p: F.when(text.rlike(p), F.regexp_extract(text, p, 1))
    keys = F.regexp_extract_all(text, F.lit(f"{share}:{NUMBER_VALUE}"), F.lit(1))
    vals = F.regexp_extract_all(text, F.lit(f"{share}:{NUMBER_VALUE}"), F.lit(2))
    shares = F.zip_with(keys, vals, lambda k, v: F.struct(k.alias("key"), v.try_cast("double").alias("x")))
    cols = [get(STEP_KEY).cast("bigint").alias("step"), get(f"{metric}:{NUMBER_VALUE}").try_cast("double").alias("metric"), shares.alias("shares")]
    cols += [get(f"{p}:{NUMBER_VALUE}").try_cast("double").alias(n) for n, p in (extra or {}).items()]
    rows = lines.withColumn("__at", F.monotonically_increasing_id()).select("__at", *cols)
    rows = rows.filter(F.col("step").isNotNull() & F.col("metric").isNotNull() & (F.size("shares") > 0))
    names = [c for c in rows.columns if c not in ("step", "__at")]
    return rows.groupBy("step").agg(F.max_by(F.struct(*names), "__at").alias("r")).select("step", "r.*")


def detrend(steps: DataFrame, window: int = 15, step: str = "step", value: str = "metric", block: int = 65536) -> DataFrame:
    """Value minus its centred rolling median.

    Rows are numbered in order and cut into blocks; a row near the edge of a block also goes to its neighbour, so a block sees the
    ``window // 2`` rows on either side of it and no task sees more than a block and its edges.
    """
    half = window // 2
    if not half < block:
        raise ValueError("the window must be shorter than a block")
    place = F.col("__i") - 1
    at = lambda shift: F.floor((place + shift) / block).cast("bigint")
    rows = ranked(steps, [], [F.col(step)], value_buckets(F.col(step)), "__i").withColumn("__own", at(0))
    near = rows.withColumn("__block", F.explode(F.array_distinct(F.array(at(-half), at(0), at(half)))))
    w = Window.partitionBy("__block").orderBy("__i").rowsBetween(-half, half)
    out = near.withColumn("detrended", F.col(value) - F.percentile(F.col(value), F.lit(0.5)).over(w))
    return out.filter(F.col("__block") == F.col("__own")).drop("__i", "__own", "__block")


def composition_regression(
    steps: DataFrame, replicates: int = 0, step: str = "step", target: str = "detrended", shares: str = "shares", seed: int = 0
) -> DataFrame:
    """Least squares of the detrended metric on centred composition shares (G32): slope, mean share, R2, bootstrap interval.

    Spark sums the normal equations over steps; the last step solves a system as small as the number of categories, with the
    minimum-norm solution because shares add up to one.
    """
    base = steps.select(step, F.col(target).alias("y"), F.map_from_entries(
        F.array_distinct(F.transform(shares, lambda e: F.struct(e["key"], e["x"])))).alias("m"))
    keys = base.select(F.explode(F.map_keys("m")).alias("k")).distinct().agg(F.array_sort(F.collect_list("k")).alias("ks"))
    base = base.withColumn("ks", scalar_row(keys)["ks"])
    vec = F.transform("ks", lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit(0.0)))
    base = base.select(step, "y", "ks", vec.alias("x"))
    means = base.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"))
    centre = scalar_row(means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda e: e["mean"]).alias("mu")))["mu"]
    base = base.withColumn("mu", centre).withColumn("c", F.zip_with("x", "mu", lambda a, b: a - b))
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates)))
    count = poisson_count(hash_unit(stable_hash(step, "rep", seed=seed)))
    rows = base.withColumn("rep", reps).withColumn("w", F.when(F.col("rep") == 0, F.lit(1)).otherwise(count))
    outer = F.flatten(F.transform("c", lambda a, i: F.transform(F.col("c"), lambda b, j: F.struct(i.alias("i"), j.alias("j"), (a * b).alias("v")))))
    right = F.transform("c", lambda a, i: F.struct(i.alias("i"), F.lit(-1).alias("j"), (a * F.col("y")).alias("v")))
    moments = F.array(
        F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), (F.col("y") * F.col("y")).alias("v")),
        F.struct(F.lit(-2).alias("i"), F.lit(-1).alias("j"), F.col("y").alias("v")),
        F.struct(F.lit(-3).alias("i"), F.lit(-1).alias("j"), F.lit(1.0).alias("v")),
    )
    sums = rows.select("rep", "w", F.inline(F.concat(outer, right, moments))).groupBy("rep", "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["i"].max()) + 1
        gram, rhs = np.zeros((k, k)), np.zeros(k)
        cells = pdf[pdf["i"] >= 0]
        for i, j, v in cells[["i", "j", "v"]].itertuples(index=False):
            if j >= 0:
                gram[int(i), int(j)] = v
            else:
                rhs[int(i)] = v
        got = {int(i): v for i, v in pdf[pdf["i"] < 0][["i", "v"]].itertuples(index=False)}
        coef = np.linalg.pinv(gram, rcond=1e-10) @ rhs
        n = got[-3]
        spread = got[-1] / n - (got[-2] / n) ** 2
        rss = (got[-1] - 2 * coef @ rhs + coef @ gram @ coef) / n - (got[-2] / n) ** 2
        r2 = 1.0 - rss / spread if spread > 0 else float("nan")
        return pd.DataFrame({"rep": pdf["rep"].iloc[0], "i": range(k), "slope": coef, "r2": r2})

    fits = sums.groupBy("rep").applyInPandas(solve, "rep int, i int, slope double, r2 double")
    per = fits.groupBy("i").agg(
        F.max(F.when(F.col("rep") == 0, F.col("slope"))).alias("slope"), F.max(F.when(F.col("rep") == 0, F.col("r2"))).alias("r2"),
        F.percentile(F.when(F.col("rep") > 0, F.col("slope")), F.lit(0.025)).alias("low"),
        F.percentile(F.when(F.col("rep") > 0, F.col("slope")), F.lit(0.975)).alias("high"),
    )
    names = base.agg(F.first("ks").alias("ks"), F.first("mu").alias("mu"))
    labels = scalar_row(names)
    out = per.withColumn("__l", labels)
    return out.select(F.get(F.col("__l.ks"), F.col("i")).alias("key"), "slope", "r2", "low", "high", F.get(F.col("__l.mu"), F.col("i")).alias("mean_share"))


register_metric("bleu")(corpus_bleu)
register_metric("chrf")(corpus_chrf)
register_metric("cider")(cider)
register_metric("f1_mcc")(binary_scores)
register_metric("brier_score")(brier)
