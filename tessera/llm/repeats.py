"""Passages that repeat, found by a suffix array over sampled positions (op 13).

Every window of ``WINDOW`` bytes owns one sampled position: the place of the
least hash among its first ``GRAMS`` byte grams.  Equal windows own the same
place at the same distance, so nothing is lost by looking at sampled positions
only.  The ``SYMBOL`` bytes from a sampled position decide where the next one
is; as symbols they make a string some hundred times shorter than the text, and,
named in byte order, its suffix array is the order of the text's suffixes at
sampled positions.  A symbol that occurs once in all texts cannot lie inside a
repeated window: it ends its run, and runs of one are left out.

The suffix array is built by the tuples and the difference cover of ``suffixes``.  Suffixes next
to each other in it are compared by fingerprints of ``LADDER`` prefixes; that
gives how far each one agrees with any other, hence which of its windows can
repeat.  Positions whose windows all agree with another's are settled by one
fingerprint over their whole span; of the rest, and of one position of each
settled kind beside them, windows are compared by fingerprints in their group:
first what ``CORE`` neighbouring windows have in common, then, where that
repeats, each window.

Fingerprints are of 64 bits (polynomials over mixed bytes); a false window needs
an equal prefix fingerprint of 209 bytes and an equal one of its 400 bytes.

Scale: texts are read twice and shuffled twice (once with the sampled positions
that may repeat, once with the findings).  Sampled positions are one row in some
hundred bytes, rows after the sieve a few in a thousand bytes; a copied passage
combines in the task (one count a fingerprint), and joins on fingerprints are
left to Spark to split.  No step holds more than one document and pieces of two
million bytes; tables between stages lie in the shared folder.

Edges: a null or empty text has 0 bytes and nothing to remove, texts shorter
than a window have no window, repeated rows repeat each other, a text of one
repeated byte repeats itself, no rows give no rows, other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, materialize, release, scratch
from .suffixes import following, numbered, text_ranks

#: Bytes of a repeated string; grams in a choice and bytes of a gram; bytes that decide the next choice.
WINDOW, GRAMS, GRAM = 400, 192, 16
SYMBOL = GRAMS + GRAM
#: Prefixes of sampled suffixes that are compared: the least that two equal windows share, two between, the whole.
LADDER = (WINDOW - GRAMS + 1, 272, 336, WINDOW)
#: Distances of windows that are first compared by what they have in common.
CORE = 16
#: Bytes that are fingerprinted at once: what is made of them stays in a core's cache.
_PIECE = 131_072
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the step, of its inverse, and a mixed number for each byte."""
    n = _PIECE + 4 * WINDOW
    up, down = np.full(n, _STEP, np.uint64), np.full(n, pow(_STEP, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    bytes_ = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
    return np.cumprod(up), np.cumprod(down), bytes_


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class Prints:
    """Fingerprints of stretches of up to about ``_PIECE`` bytes."""

    def __init__(self, data: np.ndarray) -> None:
        up, self._down, mixed = _powers()
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mixed[data] * up[: len(data)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return _mixed((self._sums[end] - self._sums[start]) * self._down[start] + length * np.uint64(_STEP)).astype(np.int64)

    def grams(self, size: int) -> np.ndarray:
        n = len(self._sums) - size
        return _mixed((self._sums[size:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, np.uint64)


def choices(data: np.ndarray, prints: Prints) -> np.ndarray:
    """For each place with ``GRAMS`` whole grams from it on, the place of the least of them (the first if equal)."""
    h = prints.grams(GRAM)
    least = (h >> np.uint64(22) << np.uint64(22)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width < GRAMS and len(least):
        step = min(width, GRAMS - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (least & np.uint64((1 << 22) - 1)).astype(np.int64)


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) of whole texts and of overlapping pieces of long ones, about ``_PIECE`` bytes at a time."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for offset in range(0, max(len(text) - SYMBOL, 0) + 1, _PIECE // 2):
            piece = text[offset : offset + _PIECE // 2 + 3 * WINDOW]
            if size + len(piece) > _PIECE + 3 * WINDOW and held:
                yield held
                held, size = [], 0
            held.append((number, offset, piece))
            size += len(piece)
            if offset + len(piece) >= len(text):
                break
    if held:
        yield held


def sampled(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """text, pos, gap (to the next position, 0: none), near and far (distances of the first and last owned window), symbol.

    ``far`` is -1 where no whole window owns the position.  The arrays of one
    text come in order; a position that two pieces share is one row.
    """
    for held in _pieces(texts):
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        if len(data) < SYMBOL:
            continue
        prints = Prints(data)
        chosen = choices(data, prints)
        owner, whole = np.full(len(chosen), -1, np.int64), np.zeros(len(chosen), bool)
        stop, shift, at = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64), 0
        for i, (number, offset, piece) in enumerate(held):
            total = len(texts[number])
            last = min(len(piece) - SYMBOL + 1, _PIECE // 2 if offset + len(piece) < total else len(piece))
            if last > 0:
                owner[at : at + last] = i
                whole[at : at + max(0, min(last, total - offset - WINDOW + 1))] = True
            stop[i], shift[i] = at + len(piece), at - offset
            at += len(piece)
        places = np.flatnonzero(owner >= 0)
        if not len(places):
            continue
        pos, own = chosen[places], owner[places]
        new = np.append(True, (pos[1:] != pos[:-1]) | (own[1:] != own[:-1]))
        cut = np.flatnonzero(new)
        ends = np.append(cut[1:], len(places))
        pos, own, low = pos[cut], own[cut], places[cut]
        counts = np.add.reduceat(whole[places].astype(np.int64), cut)
        far, near = np.where(counts > 0, pos - low, -1), np.where(counts > 0, pos - (low + counts - 1), 0)
        gap = np.append(pos[1:] - pos[:-1], 0)
        gap[np.append(own[1:] != own[:-1], True)] = 0
        symbol = prints(pos, np.minimum(pos + SYMBOL, stop[own]))
        number = np.array([n for n, _, _ in held])[own]
        yield number, pos - shift[own], gap, near, far, symbol


def _joined(parts: Iterator[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """One array a column; the last position of a piece and the first of the next are one."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * 6
    number, pos, gap, near, far, symbol = columns
    if not len(number):
        return columns
    same = np.append(False, (number[1:] == number[:-1]) & (pos[1:] == pos[:-1]))
    for i in np.flatnonzero(same):
        gap[i - 1] = gap[i]
        if far[i] >= 0:
            near[i - 1] = near[i]
            far[i - 1] = max(far[i], far[i - 1])
    number, pos, gap, near, far, symbol = (c[~same] for c in (number, pos, gap, near, far, symbol))
    edge = np.flatnonzero((number[1:] == number[:-1]) & (gap[:-1] == 0))
    gap[edge] = pos[edge + 1] - pos[edge]
    return [number, pos, gap, near, far, symbol]


def sample_positions(keyed: DataFrame) -> DataFrame:
    """uid, pos, gap, near, far, symbol of every sampled position of (uid, body)."""
    names = ["uid", "pos", "gap", "near", "far", "symbol"]
    kinds = [pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int16(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= 16 * _PIECE):
                    size += len(texts[stop])
                    stop += 1
                columns = _joined(sampled(texts[start:stop]))
                columns[0] = uids[start:stop][columns[0]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
                start = stop

    return keyed.mapInArrow(run, "uid long, pos long, gap short, near short, far short, symbol long")


def _elements(uid: int, text: bytes, pos: np.ndarray, gap: np.ndarray, near: np.ndarray, far: np.ndarray, symbol: np.ndarray) -> dict:
    """The string of one text: kept positions, after each run the position that ends it or an end mark, with fingerprints."""
    n, data = len(text), np.frombuffer(text, np.uint8)
    onward = pos + gap
    broken = np.append(onward[:-1] != pos[1:], True) | (gap == 0)
    end_pos = np.where(gap == 0, n, onward)[broken]
    at, kind = np.concatenate([pos, end_pos]), np.concatenate([np.zeros(len(pos), np.int64), np.where(gap[broken] == 0, 2, 1)])
    zero, none = np.zeros(len(end_pos), np.int64), np.full(len(end_pos), -1, np.int64)
    near, far, symbol = np.concatenate([near, zero]), np.concatenate([far, none]), np.concatenate([symbol, zero])
    order = np.lexsort((kind, at))
    at, kind, near, far, symbol = (c[order] for c in (at, kind, near, far, symbol))
    made = {"kind": kind, "pos": at, "near": near, "far": far, "symbol": symbol, "span": np.zeros(len(at), np.int64)}
    rungs = np.zeros((len(LADDER), len(at)), np.int64)
    for low in range(0, n + 1, _PIECE // 2):
        inside = (at >= low) & (at < low + _PIECE // 2)
        if not inside.any():
            continue
        base = max(0, low - WINDOW)
        prints, p = Prints(data[base : low + _PIECE // 2 + 2 * WINDOW]), at[inside] - base
        ends = np.minimum(p + SYMBOL, n - base)
        made["symbol"][inside] = np.where(kind[inside] == 1, prints(p, ends), symbol[inside])
        for r, size in enumerate(LADDER):
            rungs[r, inside] = prints(p, np.minimum(p + size, n - base))
        owned = far[inside] >= 0
        low_p, high_p = np.where(owned, p - far[inside], p), np.where(owned, p - near[inside] + WINDOW, p)
        made["span"][inside] = prints(low_p, high_p)
    marks = kind == 2
    made["symbol"][marks] = _mixed(np.array([uid], np.int64).astype(np.uint64) * np.uint64(_STEP) + np.uint64(1)).astype(np.int64)
    made["uid"] = np.full(len(at), uid, np.int64)
    starts, stops, has = at - far, at - near + WINDOW, far >= 0
    region, made["bodies"] = np.full(len(at), -1, np.int64), {}
    if has.any():
        s, e = starts[has], np.maximum.accumulate(stops[has])
        heads = np.append(True, s[1:] > e[:-1])
        region[has] = s[np.maximum.accumulate(np.where(heads, np.arange(len(s)), 0))]
        ends = np.append(np.flatnonzero(heads)[1:] - 1, len(s) - 1)
        first = np.flatnonzero(has)[heads]
        made["bodies"] = dict(zip(first.tolist(), zip(s[heads].tolist(), e[ends].tolist(), strict=True), strict=True))
    made["region"] = region
    made["rungs"] = [np.where(at + size <= n, rungs[r], 0) for r, size in enumerate(LADDER)]
    made["fits"] = [at + size <= n for size in LADDER]
    return made


_RUNGS = [f"r{i}" for i in range(len(LADDER))]
_ELEMENT = f"uid long, kind byte, pos long, near short, far short, symbol long, {', '.join(f'{r} long' for r in _RUNGS)}, span long, region long, payload binary, body binary"


def build_string(keyed: DataFrame, kept: DataFrame, extra: DataFrame) -> DataFrame:
    """The elements of the texts' strings, with symbols' bytes where first met and regions' bytes where they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            flat = {c: batch.column(c) for c in ("pos", "gap", "near", "far", "symbol")}
            for i, (uid, text) in enumerate(zip(batch.column("uid").to_pylist(), batch.column("body").to_pylist(), strict=True)):
                own = {c: np.asarray(v[i].values.to_numpy(zero_copy_only=False)).astype(np.int64) for c, v in flat.items()}
                made = _elements(uid, text, **own)
                n = len(made["pos"])
                payload: list = [None] * n
                for j, s in enumerate(made["symbol"].tolist()):
                    if s not in seen:
                        seen.add(s)
                        payload[j] = b"" if made["kind"][j] == 2 else text[made["pos"][j] : made["pos"][j] + SYMBOL]
                if len(seen) > 500_000:
                    seen.clear()
                body: list = [None] * n
                for j, (a, b) in made["bodies"].items():
                    body[j] = text[a:b]
                rungs = [pa.array(v, pa.int64(), mask=~f) for v, f in zip(made["rungs"], made["fits"], strict=True)]
                columns = [
                    pa.array(made["uid"]), pa.array(made["kind"], pa.int8()), pa.array(made["pos"]),
                    pa.array(made["near"], pa.int16()), pa.array(made["far"], pa.int16()), pa.array(made["symbol"]), *rungs, pa.array(made["span"]), pa.array(made["region"]), pa.array(payload, pa.binary()), pa.array(body, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ELEMENT.split(", ")])

    listed = kept.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", "gap", "near", "far", "symbol"))).alias("own"))
    listed = listed.join(extra, "uid", "left_anti")
    flat = keyed.join(listed, "uid").select("uid", "body", *(F.col(f"own.{c}").alias(c) for c in ("pos", "gap", "near", "far", "symbol")))
    return flat.mapInArrow(run, _ELEMENT)


def window_prints(candidates: DataFrame, bodies: DataFrame, step: int = 1) -> DataFrame:
    """Fingerprints of the windows in the ranges of ``candidates`` (uid, region, group, pos, low, high, need).

    Rows are group, print, need, uid, region, pos, low and high.  With a
    ``step`` above 1 the distances low to high are dealt into blocks of so many,
    and the print is that of the bytes which all windows of a block have in
    common: where it occurs once, none of them repeats.
    """
    fields = ("group", "pos", "low", "high", "need")
    listed = candidates.groupBy("uid", "region").agg(F.collect_list(F.struct(*fields)).alias("own"))
    flat = bodies.join(listed, ["uid", "region"]).select("uid", "region", "body", *(F.col(f"own.{c}").alias(c) for c in fields))
    names = ["group", "print", "need", "uid", "region", "pos", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (uid, region, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("uid", "region", "body")), strict=True)):
                group, pos, low, high, need = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in fields)
                low, high = low.astype(np.int64), high.astype(np.int64)
                first, sizes = low // step, high // step - low // step + 1
                which = np.repeat(np.arange(len(pos)), sizes)
                block = np.repeat(first - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(len(which))
                begin, length = pos[which] - block * step, WINDOW - step + 1
                data, prints = np.frombuffer(text, np.uint8), np.zeros(len(which), np.int64)
                for base in range(0, len(data), _PIECE // 2):
                    inside = (begin - region >= base) & (begin - region < base + _PIECE // 2)
                    if inside.any():
                        p = begin[inside] - region - base
                        prints[inside] = Prints(data[base : base + _PIECE // 2 + WINDOW])(p, p + length)
                ranges = np.maximum(low[which], block * step), np.minimum(high[which], block * step + step - 1)
                n = len(which)
                columns = [group[which], prints, need[which].astype(bool), np.full(n, uid), np.full(n, region), pos[which], *(r.astype(np.int32) for r in ranges)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return flat.mapInArrow(run, "group long, print long, need boolean, uid long, region long, pos long, low int, high int")


def _repeating(prints: DataFrame) -> DataFrame:
    """The rows whose print occurs more than once in their group."""
    twice = prints.groupBy("group", "print").agg(F.count("*").alias("n")).filter("n > 1").select("group", "print")
    return prints.join(twice, ["group", "print"], "left_semi")


def repeated_windows(keyed: DataFrame, folder: str) -> DataFrame:
    """uid, low and high of windows (their first bytes, both ends included) of (uid, body, digest) that begin somewhere else too.

    Texts that are equal repeat each other whole; one of them stands for them
    in the string.
    """
    same = keyed.groupBy("digest").agg(F.count("*").alias("n"), F.min("uid").alias("first")).filter("n > 1").select("digest", "first")
    sizes = keyed.select("uid", "digest", F.octet_length("body").cast("long").alias("size"))
    copied = materialize(sizes.join(same, "digest").select("uid", "size", (F.col("uid") != F.col("first")).alias("extra")), f"{folder}/copied")
    whole = copied.select("uid", F.lit(0).cast("long").alias("low"), (F.col("size") - WINDOW).alias("high"))
    return whole.unionAll(_sampled_windows(keyed.select("uid", "body"), copied.filter("extra").select("uid"), folder))


def _sampled_windows(keyed: DataFrame, extra: DataFrame, folder: str) -> DataFrame:
    spark = keyed.sparkSession
    places = materialize(sample_positions(keyed), f"{folder}/sampled")
    often = materialize(places.groupBy("symbol").agg(F.count("*").alias("n")).filter("n > 1").select("symbol"), f"{folder}/often")
    kept = materialize(places.join(often, "symbol", "left_semi"), f"{folder}/kept")
    discard(spark, f"{folder}/sampled")
    release(spark)
    elements = materialize(build_string(keyed, kept, extra), f"{folder}/elements")
    release(spark)
    total = elements.count()
    if not total:
        return elements.select("uid", F.col("pos").alias("low"), F.col("pos").alias("high")).filter("false")
    spelled = elements.filter("payload IS NOT NULL").groupBy("symbol").agg(F.min("payload").alias("payload"))
    spelled = materialize(spelled, f"{folder}/symbols")
    n_names = spelled.count()
    names = numbered(spelled, ["payload", "symbol"], f"{folder}/names", n_names).select("symbol", (F.col("at") + 1).alias("c"))
    string = elements.select("uid", "pos", (F.col("kind") != 0).alias("stop"), "symbol").join(names, "symbol")
    placed = elements.drop("payload", "body").join(text_ranks(string, total, n_names, f"{folder}/suffixes"), ["uid", "pos"])
    agree = {f"p{i}": F.lag(r) for i, r in enumerate(_RUNGS)} | {f"n{i}": F.lead(r) for i, r in enumerate(_RUNGS)}
    beside = following(placed.select("rank", "uid", "pos", "near", "far", "span", "region", *_RUNGS), agree, "rank", reach=1, back=1)
    same = [F.coalesce(F.col(r) == F.col(f"p{i}"), F.lit(False)) | F.coalesce(F.col(r) == F.col(f"n{i}"), F.lit(False)) for i, r in enumerate(_RUNGS)]
    # where the prefix of a rung differs from both neighbours', no window that reaches so far can repeat
    least = F.lit(None).cast("int")
    for agreed, beyond in zip(same, [*LADDER[1:], WINDOW + 1], strict=True):
        least = F.when(agreed, F.lit(WINDOW - beyond + 1)).otherwise(least)
    alike = beside.filter(same[0] & (F.col("far") >= 0)).withColumn("low", F.greatest(F.col("near").cast("int"), least)).filter("low <= far")
    alike = alike.select(F.col("r0").alias("group"), "span", "uid", "pos", "region", "low", F.col("near").cast("int").alias("near"), F.col("far").cast("int").alias("high"))
    alike = materialize(alike, f"{folder}/alike")
    for spent in ("suffixes", "names", "symbols", "often", "kept"):
        discard(spark, f"{folder}/{spent}")
    release(spark)
    one = F.min(F.struct("uid", "pos", "region", "low", "near", "high")).alias("one")
    kinds = materialize(alike.groupBy("group", "span").agg(F.count("*").alias("n"), one), f"{folder}/kinds")
    settled = alike.join(kinds.filter("n > 1").select("group", "span"), ["group", "span"], "left_semi").select("uid", (F.col("pos") - F.col("high")).alias("low"), (F.col("pos") - F.col("near")).alias("high"))
    open_groups = kinds.groupBy("group").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1").select("group")
    candidates = kinds.join(open_groups, "group", "left_semi").select("group", "one.*", (F.col("n") == 1).alias("need"))
    bodies = elements.filter("body IS NOT NULL").select("uid", "region", "body")
    cores = _repeating(materialize(window_prints(candidates, bodies, CORE), f"{folder}/cores"))
    cores = materialize(cores.drop("print"), f"{folder}/repeating")
    release(spark)
    prints = materialize(window_prints(cores, bodies).select("group", "print", "need", "uid", (F.col("pos") - F.col("low")).alias("low")), f"{folder}/prints")
    single = _repeating(prints).filter("need").select("uid", "low", F.col("low").alias("high"))
    return settled.unionAll(single)


def merged_spans(lows: np.ndarray, highs: np.ndarray) -> list[tuple[int, int]]:
    """Runs of bytes covered by windows that begin at low to high."""
    order = np.argsort(lows, kind="stable")
    lows, ends = lows[order], np.maximum.accumulate(highs[order] + WINDOW)
    heads = np.append(True, lows[1:] > ends[:-1])
    starts = lows[heads]
    stops = ends[np.append(np.flatnonzero(heads)[1:] - 1, len(ends) - 1)]
    return list(zip(starts.tolist(), stops.tolist(), strict=True))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, body (bytes of the text) and spans (array of start and end of removed runs) of every row."""
    spark = docs.sparkSession
    folder = scratch(spark, "repeats")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = materialize(documents(docs).select(F.monotonically_increasing_id().alias("uid"), "doc_id", body.alias("body"), F.unhex(F.md5(body)).alias("digest")), f"{folder}/keyed")
    found = repeated_windows(keyed.filter(F.octet_length("body") >= WINDOW).select("uid", "body", "digest"), folder)
    marks = materialize(found.groupBy("uid").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")), f"{folder}/marks")
    for spent in ("elements", "copied", "alike", "kinds", "cores", "repeating", "prints"):
        discard(spark, f"{folder}/{spent}")
    release(spark)
    return keyed.join(marks, "uid", "left")


def passage_digest(docs: DataFrame) -> DataFrame:
    """The rows of the contract."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            rows = []
            lows, highs = batch.column("lows"), batch.column("highs")
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), strict=True)):
                spans = merged_spans(*(c[i].values.to_numpy(zero_copy_only=False) for c in (lows, highs))) if lows[i].is_valid else []
                digest, at, gone = hashlib.sha256(), 0, 0
                for a, b in spans:
                    digest.update(text[at:a])
                    at, gone = b, gone + b - a
                digest.update(text[at:])
                rows.append((doc_id, len(text), gone, len(spans), digest.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return repeated_spans(docs).select("doc_id", "body", "lows", "highs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
