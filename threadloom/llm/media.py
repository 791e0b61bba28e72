"""Media columns: chroma fingerprints of audio, and the alignment of recordings.

A recording is PCM audio in a WAV value. Frames of FRAME samples, HOP apart, are folded from a spectrum into
twelve pitch classes. Filters (differences of rectangle sums over time and pitch class, read from an integral
image of log chroma) give two bits each; a frame's bits are one packed integer. Recordings that hold the same
integers are candidates: the offsets at which integers agree form a histogram, its peak aligns the two, and
the share of bits that differ over the overlap decides.

Equal fingerprints are one class from the start. Different ones are candidates if they share any integer but silence's: recordings are dealt
to groups, every two groups are a cell, and in a cell every two places with equal integers are met. They tell an offset, and the
overlap there is compared whole (the sum ends early where it is too large already). What passes is aligned, and what links
connect already is not compared again, nor are two places that have met. So the groups are those of an aligner of all pairs that share a sound. The work is that of all pairs of places
with equal integers, which grows with the square of the table where integers agree by chance.

Cases: null, empty or undecodable values have no frames, no fingerprint and a group of their own (their id).
Recordings shorter than a frame are padded to one, and those of fewer than WIDTH frames to WIDTH, with silence;
such short ones are equal only if they have equally many frames. Null ids are kept, linked with nothing. Equal recordings
are one class; ties of the histogram's peak go to the smallest offset. Any length is read whole, in blocks.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import common

RATE, FRAME, HOP = 11025, 4096, 1365
LOW, HIGH = 28.0, 3520.0
#: Filters: frames wide, first pitch class, pitch classes high, kind (0 halves over time, 1 halves over pitch, 2 time thirds, 3 whole against mean).
FILTERS = ((4, 0, 12, 0), (4, 0, 6, 0), (4, 6, 6, 0), (4, 0, 4, 1), (4, 4, 4, 1), (4, 8, 4, 1), (6, 0, 12, 2), (6, 2, 8, 1), (8, 0, 6, 1), (8, 6, 6, 1), (4, 0, 2, 1), (4, 2, 2, 1), (4, 5, 2, 1), (4, 7, 2, 1), (4, 9, 2, 1), (8, 0, 12, 0))
WIDTH = 8
#: Two recordings match if at least MIN_FRAMES overlapping integers differ in at most ERROR of their bits.
ERROR, MIN_FRAMES = 0.15, 12
#: Integers of a group of recordings; groups (of FEW_INTS integers at least) that a smaller table is dealt to, for the cores' sake.
CELL, GROUPS, FEW_INTS = 2_000_000, 6, 20_000
#: Pairs of places that are compared together, and integers of an overlap between two looks at its sum.
PIECE, STEP = 1 << 18, 16
#: Masks that leave the first 0, 1, ... of STEP integers, and the constants that add eight bytes.
_ENDS = np.where(np.arange(STEP) < np.arange(STEP)[:, None], np.uint32(0xFFFFFFFF), np.uint32(0)).view(np.uint64)
_EVEN, _ADD = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)
#: `around` takes one bit of each of 2 * AROUND integers.
AROUND, CONTEXT_BIT = 32, 0
#: Classes that a task remembers.
REMEMBERED = 500_000
#: Places of an integer in a recording beyond which its votes are counted by correlation.
MANY = 64


def pitch_map(rate: int) -> np.ndarray:
    """(bins, 12) membership of spectrum bins in pitch classes."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    ok = (hz >= LOW) & (hz <= HIGH)
    out = np.zeros((len(hz), 12), np.float32)
    note = np.round(12 * np.log2(np.maximum(hz, 1e-9) / 440.0)).astype(int) % 12
    out[np.flatnonzero(ok), note[ok]] = 1
    return out


_MAPS: dict[int, np.ndarray] = {}
_HANN = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12) normalised pitch-class energies; spectra are taken in blocks of frames."""
    if not len(samples):
        return np.zeros((0, 12), np.float32)
    if rate not in _MAPS:
        _MAPS[rate] = pitch_map(rate)
    x = np.asarray(samples, np.float32)
    x = np.pad(x, (0, max(FRAME - len(x), 0)))
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = [(np.abs(np.fft.rfft(view[i : i + 64] * _HANN, axis=1)).astype(np.float32) ** 2) @ _MAPS[rate] for i in range(0, len(view), 64)]
    energy = np.concatenate(out)
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1e-3, energy / np.maximum(norm, 1e-9), 0).astype(np.float32)


def fingerprints_of(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """Of each recording's frames one 32-bit integer per position: sixteen filters of two bits.

    Recordings of fewer than WIDTH frames are padded to one position; those without frames have none. All lie in one
    integral image, in whole numbers, so that equal frames give equal integers wherever they lie.
    """
    sizes = np.array([len(f) for f in recordings], np.int64)
    padded = np.where(sizes, np.maximum(sizes, WIDTH), 0)
    starts = np.cumsum(padded) - padded
    frames = np.zeros((int(padded.sum()), 12), np.int64)
    for f, start in zip(recordings, starts, strict=True):
        frames[start : start + len(f)] = np.rint(1024 * np.log1p(8 * f.astype(np.float64)))
    image = np.zeros((len(frames) + 1, 13), np.int64)
    image[1:, 1:] = np.cumsum(np.cumsum(frames, axis=0), axis=1)
    n = max(len(frames) - WIDTH + 1, 0)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        strip = image[:, p1] - image[:, p0]
        return strip[t1 : t1 + n] - strip[t0 : t0 + n]

    out = np.zeros(n, np.uint32)
    for k, (wide, low, high, kind) in enumerate(FILTERS):
        top, mid_t, mid_p = low + high, wide // 2, low + high // 2
        if kind == 0:
            v = area(mid_t, wide, low, top) - area(0, mid_t, low, top)
        elif kind == 1:
            v = area(0, wide, mid_p, top) - area(0, wide, low, mid_p)
        else:
            third = wide // 3
            v = 2 * area(third, 2 * third, low, top) - area(0, third, low, top) - area(2 * third, wide, low, top)
        scale = 20 * wide * high
        two = (v > scale).astype(np.uint32) + (v > 0) + (v > -scale)
        out |= (two ^ (two >> 1)).astype(np.uint32) << np.uint32(2 * k)  # Gray code: neighbours differ in one bit
    return [out[start : start + max(size - WIDTH + 1, 0)] if size else out[:0] for start, size in zip(starts, padded, strict=True)]


def fingerprint(frames: np.ndarray) -> np.ndarray:
    return fingerprints_of([frames])[0]


SILENCE = np.uint32(fingerprint(np.zeros((WIDTH, 12), np.float32))[0])


def decode_wav(value: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a 16-bit WAV value; nothing if it is none."""
    try:
        with wave.open(io.BytesIO(value or b"")) as w:
            raw = np.frombuffer(w.readframes(w.getnframes()), "<i2") if w.getsampwidth() == 2 else np.zeros(0, "<i2")
            return raw[: len(raw) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(axis=1) / 32768, w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0), RATE


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, float, int]:
    """(offset of b in a, share of differing bits, overlapping integers) at the peak of the offset histogram."""
    if not len(a) or not len(b):
        return 0, 1.0, 0
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = high - low
    votes = np.zeros(len(a) + len(b) - 1, np.int64)  # of offset i - j, at i - j + len(b) - 1
    # An integer of many places in b votes by correlation of its places, so that memory stays bounded.
    size = 1 << (len(votes) - 1).bit_length()
    for v in np.unique(a[n > MANY]):
        votes += np.rint(np.fft.irfft(np.fft.rfft(a == v, size) * np.fft.rfft(b[::-1] == v, size), size)[: len(votes)]).astype(np.int64)
    n = np.where(n > MANY, 0, n)
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    votes += np.bincount(i - j + len(b) - 1, minlength=len(votes))
    if not votes.any():
        return 0, 1.0, 0
    offset = int(np.argmax(votes)) - len(b) + 1
    x, y = a[max(offset, 0) :], b[max(-offset, 0) :]
    m = min(len(x), len(y))
    return offset, float(np.bitwise_count(x[:m] ^ y[:m]).sum()) / (32 * m), m


_PRINTS = "id long, n_frames long, n_ints long, h long, ints array<int>"


def _prints(rows: DataFrame, frames_of) -> DataFrame:
    """_PRINTS of rows (id, value); frames_of gives the frames of a list of values. h is the class: a digest of the integers
    (and of the frames of a short recording). A task gives the integers of a class once, with its first recording."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in common.rows_of(batch, 64):
                frames = frames_of(part.column(1).to_pylist())
                ints = fingerprints_of(frames)
                h = [int.from_bytes(hashlib.blake2b(x.tobytes() + (b"%d" % len(f) if len(f) < WIDTH else b""), digest_size=8).digest(), "little", signed=True) for x, f in zip(ints, frames, strict=True)]
                n, new = [len(x) for x in ints], []
                for i, c, x in zip(part.column(0).to_pylist(), h, ints, strict=True):
                    new.append(x.view(np.int32) if i is not None and c not in seen else np.zeros(0, np.int32))
                    if i is not None:
                        seen.add(c)
                if len(seen) > REMEMBERED:
                    seen.clear()
                edges = np.concatenate([[0], np.cumsum([len(x) for x in new])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(f) for f in frames], pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(new)))], ["id", "n_frames", "n_ints", "h", "ints"])

    return common.map_stream(rows, run, _PRINTS)


def fingerprints(media: DataFrame) -> DataFrame:
    """_PRINTS of rows (id, audio)."""
    return _prints(media.select(F.col("id").cast("long"), "audio"), lambda values: [chroma(*decode_wav(v)) for v in values])


def around(ints: np.ndarray) -> np.ndarray:
    """Of each place 64 bits: one bit of each integer from AROUND places before it to AROUND - 1 after it. The search of links does not use it."""
    bit = np.pad((ints >> np.uint32(CONTEXT_BIT)).astype(np.uint64) & np.uint64(1), AROUND)
    out = np.zeros(len(ints), np.uint64)
    for k in range(2 * AROUND):
        out |= bit[k : k + len(ints)] << np.uint64(k)
    return out.view(np.int64)


def _paired(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all i and all j from low[i] to before high[i], in pieces of about PIECE."""
    n = np.maximum(high - low, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")), at + 1)
        k = n[at:to]
        i, j = np.repeat(np.arange(at, to), k), np.repeat(low[at:to] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        yield i, j
        at = to


def _rows(ints: np.ndarray) -> np.ndarray:
    """Of each place the STEP integers from there on, zeros behind the last one, as one value: comparing reads a place's memory once."""
    padded = np.concatenate([ints, np.zeros(STEP, np.uint32)])
    return np.ndarray(len(ints) + 1, f"V{4 * STEP}", padded, strides=(4,))


def _close(rows: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which of the overlaps (m integers from x and from y in the integers of `rows`) differ in at most ERROR of all their bits. Summing ends
    for an overlap when its sum is beyond that, so the answer is that of the whole overlap."""
    most = np.floor(ERROR * 32 * m + 1e-6).astype(np.int64)
    live, errors, out = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = 0
    while len(live):
        differ = (rows[x[live] + at].view(np.uint64) ^ rows[y[live] + at].view(np.uint64)).reshape(-1, STEP // 2)
        left = m[live] - at
        last = np.flatnonzero(left < STEP)
        differ[last] &= _ENDS[left[last]]
        # Sums of eight counts of at most 64: by twos, then the four of them in the top 16 bits of a product.
        count = np.bitwise_count(differ).view(np.uint64)
        count = ((count & _EVEN) + (count >> np.uint64(8) & _EVEN)) * _ADD >> np.uint64(48)
        errors[live] += count.reshape(len(live), -1).sum(axis=1).astype(np.int64)
        at += STEP
        live = live[errors[live] <= most[live]]
        out[live[m[live] <= at]] = True
        live = live[m[live] > at]
    return out


def cell_links(ints: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Of recordings of one side, or of two sides, the links (places in the list) that connect all those that align and are
    of different sides, if there are two. Every pair of places with equal integers (not silence) tells an offset whose whole overlap is
    compared; what passes is aligned. First each place meets the longest recording of its integer, then what that has not
    connected meets pairwise."""
    sizes = np.array([len(x) for x in ints], np.int64)
    flat = np.concatenate([*ints, np.zeros(0, np.uint32)])
    start = np.cumsum(sizes) - sizes
    rec = np.repeat(np.arange(len(ints)), sizes)
    rows = _rows(flat)
    quiet = np.bincount(rec[flat == SILENCE], minlength=len(ints)) > 0
    root, found = np.arange(len(ints)), []
    two_sided = len(np.unique(side)) > 1

    def decide(a: np.ndarray, b: np.ndarray) -> None:
        """Align pairs that are not connected, and connect them."""
        nonlocal root
        up: dict[int, int] = {}

        def top(i: int) -> int:
            i = int(root[i])
            while i in up:
                i = up[i]
            return i

        for pair in np.unique(np.minimum(a, b) * len(ints) + np.maximum(a, b)).tolist():
            i, j = divmod(pair, len(ints))
            x, y = top(i), top(j)
            if x != y:
                _, error, n = align(ints[i], ints[j])
                if error <= ERROR and n >= min(MIN_FRAMES, len(ints[i]), len(ints[j])):
                    up[max(x, y)] = min(x, y)
                    found.append((i, j))
        if up:
            now = np.arange(len(ints))
            now[list(up)] = [top(i) for i in up]
            root = now[root]

    def meet(x: np.ndarray, y: np.ndarray) -> None:
        """Compare the overlaps that bring places x and y (in flat) together."""
        a, b = rec[x], rec[y]
        ok = root[a] != root[b]
        x, y, a, b = x[ok], y[ok], a[ok], b[ok]
        before = np.minimum(x - start[a], y - start[b])
        m = before + np.minimum(start[a] + sizes[a] - x, start[b] + sizes[b] - y)
        ok = np.flatnonzero(m >= np.minimum(np.minimum(sizes[a], sizes[b]), MIN_FRAMES))
        # The peak of two that hold silence may be one of silence's votes, which are no places here: they are aligned at once.
        at_peak = _close(rows, (x - before)[ok], (y - before)[ok], m[ok])
        passed = quiet[a] & quiet[b]
        passed[ok[at_peak]] = True
        decide(a[passed], b[passed])

    # Values of which a recording holds MANY places and more (held tones, silence) name pairs, not pairs of places.
    values, value = np.unique(flat, return_inverse=True)
    owned, counts = np.unique(value * len(ints) + rec, return_counts=True)
    held = np.unique(owned[counts > MANY] // max(len(ints), 1))
    for w in held[values[held] != SILENCE]:
        holders = owned[np.searchsorted(owned, w * len(ints)) : np.searchsorted(owned, (w + 1) * len(ints))] - w * len(ints)
        for k, i in enumerate(holders):
            others = holders[k + 1 :]
            others = others[(root[others] != root[i]) & ((side[others] != side[i]) | (not two_sided))]
            decide(np.full(len(others), i), others)
    del owned, counts
    # Places in order of their values; of values that one recording (or one side) alone holds, none.
    lone = np.isin(np.arange(len(values)), held) | (values == SILENCE)
    mark = side[rec] if two_sided else rec
    least, most = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), -1)
    np.minimum.at(least, value, mark)
    np.maximum.at(most, value, mark)
    places = np.flatnonzero(((least < most) & ~lone)[value])
    left, right = (places[side[rec[places]] == s] for s in np.unique(side)[[0, -1]]) if two_sided else (places, places)
    met = np.full(len(flat), -1)  # the longest one that a place has met: what was compared once is not compared again
    for one, other in ((left, right), (right, left))[: 1 + two_sided]:
        longest = other[np.lexsort((sizes[rec[other]], value[other]))]
        head = longest[np.searchsorted(value[longest], value[one], "right") - 1] if len(one) else one
        new = met[head] != one
        for at in range(0, len(one), PIECE):
            some = np.flatnonzero(new[at : at + PIECE]) + at
            meet(one[some], head[some])
        met[one] = head
    by = lambda at: value[at] * len(ints) + root[rec[at]]
    left, right = left[np.argsort(by(left))], right[np.argsort(by(right))]
    one, other = by(left), by(right)
    whole = value[left] * len(ints)
    ranges = [(np.searchsorted(other, one, "right"), np.searchsorted(other, whole + len(ints)))]
    if two_sided:
        ranges.append((np.searchsorted(other, whole), np.searchsorted(other, one)))
    for low, high in ranges:
        for i, j in _paired(low, high):
            x, y = left[i], right[j]
            new = (met[x] != y) & (met[y] != x)
            meet(x[new], y[new])
    return found


def _links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of classes that connect all those that align. Recordings are dealt to groups of about CELL integers, and every
    pair of groups is one cell, so every pair of recordings meets in exactly one cell, and a cell's size does not grow with the table."""
    held = prints.where("size(ints) > 0").select("h", "ints").dropDuplicates(["h"])
    held = common.written(held, "media-classes", compression="zstd")
    total = held.agg(F.sum(F.size("ints")).alias("n")).first()["n"] or 0
    groups = max(-(-total // CELL), min(GROUPS, -(-total // FEW_INTS)), 1)
    own = held.withColumn("g", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(groups)).cast("int"))
    dealt = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("h", "ints", "g", (F.least("g", "o") * groups + F.greatest("g", "o")).alias("cell"))

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        column = cell.column("ints").combine_chunks()
        edges, flat = np.asarray(column.offsets), np.asarray(column.values).view(np.uint32)
        h, g = np.asarray(cell.column("h")), np.asarray(cell.column("g"))
        # A cell of two groups of which one is empty has nothing to do: pairs of one group meet in that group's own cell.
        two = int(cell.column("cell")[0].as_py()) // groups != int(cell.column("cell")[0].as_py()) % groups
        links = [] if two and len(np.unique(g)) < 2 else cell_links([flat[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)], g)
        a, b = (np.array([h[x[k]] for x in links], np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    # A fixed number of partitions: comparisons are dear for their bytes, and merged partitions would leave cores idle.
    links = dealt.repartition(groups * (groups + 1) // 2, "cell").groupBy("cell").applyInArrow(run, "a long, b long")
    links = common.written(links, "media-links")
    common.drop_written(held)
    return links


def align_prints(made: DataFrame) -> DataFrame:
    """(id, n_frames, n_ints, class_id, group_id) for every row of _PRINTS.

    class_id is the smallest id with the same fingerprint, group_id the smallest id that links reach.
    """
    prints = common.written(made, "media-prints", compression="zstd")
    links = _links(prints)
    found = common.components(links, "media-all")
    common.drop_written(links)

    least = prints.where("n_ints > 0 and id is not null").groupBy("h").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    least = least.join(found.select(F.col("node").alias("h"), "component"), "h", "left").withColumn("c", F.coalesce("component", "h"))
    labels = common.written(least.join(least.groupBy("c").agg(F.min("class_id").alias("group_id")), "c").select("h", "copies", "class_id", "group_id"), "media-labels")
    out = common.joined_hot(prints.select("id", "n_frames", "n_ints", "h"), labels, ["h"], "copies")
    known = (F.col("n_ints") > 0) & F.col("id").isNotNull()
    return out.select("id", "n_frames", "n_ints", *[F.when(known, F.col(c)).otherwise(F.col("id")).alias(c) for c in ("class_id", "group_id")])


def align_recordings(media: DataFrame) -> DataFrame:
    """(id, n_frames, n_ints, class_id, group_id) for every row of (id, audio)."""
    return align_prints(fingerprints(media))


def chord(word: str) -> int:
    return zlib.crc32(word.encode()) % 1728


def chord_frames() -> np.ndarray:
    """(1728, 12): the pitch-class frame of each chord of three notes."""
    out = np.zeros((1728, 12), np.float32)
    for k, notes in enumerate(zip(np.arange(1728) % 12, np.arange(1728) // 12 % 12, np.arange(1728) // 144, strict=True)):
        for note in notes:
            out[k, note] += 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def played(conversations: DataFrame) -> DataFrame:
    """_PRINTS of a stand-in for recordings, which the tables do not have: every word of a turn, in order, is a chord of three
    notes chosen by the word's hash, one frame long. The score is written down as pitch-class frames at once, not as sound.
    The id holds conv_id and turn (below 2 ** 20); null text has no frames."""
    rows = conversations.select((F.shiftleft(F.col("conv_id").cast("long"), 20) + F.col("turn")).alias("id"), "text")
    table = chord_frames()
    known: dict[str, int] = {}

    def frames_of(values):
        out = []
        for text in values:
            words = common.words_of(text or "")
            for w in words:
                if w not in known:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known[w] = chord(w)
            out.append(table[[known[w] if w in known else chord(w) for w in words]] if words else table[:0])
        return out

    return _prints(rows, frames_of)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of all turns (played), with their classes and groups; ids are split into conv_id and turn again."""
    out = align_prints(played(common.table(spark, sf_dir, "conversations")))
    return out.select(F.shiftright("id", 20).alias("conv_id"), F.col("id").bitwiseAND(F.lit((1 << 20) - 1)).alias("turn"), "n_frames", "n_ints", "class_id", "group_id")
