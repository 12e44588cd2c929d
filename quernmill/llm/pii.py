"""Personal data by a linear-chain conditional random field over word shapes.

A word is a run of bytes that aren't white space; its core lies between its first and last letter or
digit, with a ``+`` or ``(`` just before it.  In a shape, letters of any case are one class and digits
another, and all other bytes stand for themselves; runs of letters count once.  The features of a
word are its shape, that shape with runs of digits counted once too, its number of digits, the
shapes of the words beside it, and its skeleton: which bytes that are neither letters nor digits it has,
how often, and whether it has either of those; each is hashed to a row of weights, one for each tag.  Weights and
transitions are fitted by Adam to the likelihood of a small labelled table.

Decoding is Viterbi over whole texts, in numpy batches.  A word whose weight for ``O`` exceeds that
for any other tag by more than transitions can make up for is ``O`` in the best path whatever stands
beside it; only the stretches between such words are decoded, those of like length together.

Defined results: a null or empty text has no finding and is masked as itself; repeated rows and null
ids are kept; a text of one very long word is decoded as that; other columns are kept by ``mask``
and ignored by ``find``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.llm import bytescan as B
from quernmill.session import table

TAGS = ("O", "B-EMAIL", "B-IP", "B-CARD", "I-CARD", "B-PHONE", "I-PHONE", "B-SSN", "B-IBAN", "I-IBAN")
KIND = np.array([-1, 0, 1, 2, 2, 3, 3, 4, 5, 5])
BEGINS = np.array([t.startswith("B-") for t in TAGS])
KINDS = ("EMAIL", "IP", "CARD", "PHONE", "SSN", "IBAN")
BITS = 16
FEATURES = 7

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[B.IS_WORD] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_IS_CORE = B.IS_WORD.copy()
_REST = np.where(B.IS_WORD, B.U64(0), B.BYTE_CODE)


@dataclass
class Model:
    """Weights (2**BITS, tags) and transitions (tags, tags)."""

    weights: np.ndarray
    moves: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows (words, FEATURES), core starts, core ends, and the first word of each row."""
    words = B.Words(data, offsets, ~B.IS_SPACE)
    n, w = len(data), len(words)
    if not w:
        return np.zeros((0, FEATURES), np.int64), words.start, words.end, words.first
    core = _IS_CORE[data]
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(core, at, -1))[words.end - 1] + 1
    first = np.minimum.accumulate(np.where(core, at, n)[::-1])[::-1][words.start]
    none = first >= words.end
    first, last = np.where(none, words.start, first), np.where(none, words.end, last)
    before = data[np.maximum(first - 1, 0)]
    first = first - ((first > words.start) & ((before == ord("+")) | (before == ord("("))))
    kind = _CLASS[data]
    same = np.zeros(n, bool)
    same[1:] = kind[1:] == kind[:-1]
    same[first] = False
    digit = kind == ord("9")
    ids = np.empty((w, FEATURES), B.U64)
    letter = kind == ord("a")
    for k, keep in enumerate((~(same & letter), ~(same & (letter | digit)))):
        rank = np.zeros(n + 1, np.int64)
        np.cumsum(keep, out=rank[1:])
        sums = np.zeros(n + 1, B.U64)
        np.cumsum(np.where(keep, B.BYTE_CODE[kind] * B._pow(B.BASE, n + 1, "p")[rank[:-1]], B.U64(0)), out=sums[1:])
        ids[:, k] = B.mix((sums[last] - sums[first]) * B._pow(B.BASE_INV, n + 1, "q")[rank[first]] + (rank[last] - rank[first]).astype(B.U64))
    digits = np.zeros(n + 1, np.int64)
    np.cumsum(digit, out=digits[1:])
    ids[:, 2] = np.minimum(digits[last] - digits[first], 20).astype(B.U64)
    # the skeleton needs no order: a sum of codes tells which bytes, and how many, are neither letters nor digits
    rest = np.zeros(n + 1, B.U64)
    np.cumsum(_REST[data], out=rest[1:])
    size, digits_in = last - first, digits[last] - digits[first]
    others = np.zeros(n + 1, np.int32)
    np.cumsum(~core, out=others[1:])
    has_letter = size - digits_in - (others[last] - others[first]) > 0
    ids[:, 6] = B.mix(rest[last] - rest[first] + (digits_in > 0).astype(B.U64) * B.U64(2) + has_letter.astype(B.U64))
    edge = B.U64(0x5BD1E995)
    ids[1:, 3], ids[:-1, 4] = ids[:-1, 0], ids[1:, 0]
    starts, ends = words.first[:-1], words.first[1:]
    full = ends > starts
    ids[starts[full], 3] = edge
    ids[ends[full] - 1, 4] = edge
    ids[:, 5] = ids[:, 1] ^ (ids[:, 3] * B.U64(3))
    rows = np.empty((w, FEATURES), np.int64)
    for k in range(FEATURES):
        rows[:, k] = (B.mix(ids[:, k] + B.U64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> B.U64(64 - BITS)).astype(np.int64)
    return rows, first, last, words.first


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of a batch (sequences, length, tags) of equally long sequences."""
    n, length, t = scores.shape
    best = scores[:, 0]
    back = np.zeros((length, n, t), np.int8)
    for i in range(1, length):
        step = best[:, :, None] + moves
        back[i] = step.argmax(1)
        best = step.max(1) + scores[:, i]
    out = np.empty((n, length), np.int64)
    out[:, -1] = best.argmax(1)
    for i in range(length - 1, 0, -1):
        out[:, i - 1] = back[i][np.arange(n), out[:, i]]
    return out


def decode(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of all rows' words; scores (words, tags), first the first word of each row."""
    n = len(scores)
    tags = np.zeros(n, np.int64)
    slack = 2 * max(0.0, float(moves.max())) - min(0.0, float(moves[:, 0].min())) - min(0.0, float(moves[0].min()))
    open_ = scores[:, 0] - scores[:, 1:].max(1) <= slack
    if not open_.any():
        return tags
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    row_start, row_end = edge[:-1], edge[1:]
    at = np.flatnonzero(open_)
    begins = at[np.concatenate([[True], np.diff(at) > 1]) | row_start[at]]
    ends = at[np.concatenate([np.diff(at) > 1, [True]]) | row_end[at]] + 1
    # a stretch takes the sure O before and after it along, which fixes its moves there
    left, right = ~row_start[begins], ~row_end[ends - 1]
    a, b = begins - left, ends + right
    sure = np.full(scores.shape[1], -1e9)
    sure[0] = 0
    for length in np.unique(b - a):
        own = np.flatnonzero(b - a == length)
        for part in np.array_split(own, -(-len(own) * length // (1 << 16))):
            piece = scores[a[part][:, None] + np.arange(length)].copy()
            piece[left[part], 0] = sure
            piece[right[part], -1] = sure
            found = viterbi(piece, moves)
            for side in range(length):
                inside = (side >= left[part]) & (side < length - right[part])
                tags[(a[part] + side)[inside]] = found[inside, side]
    return tags


def spans(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Findings of some rows: (row, kind, start, end), in bytes of the row."""
    rows, start, end, first = features(data, offsets)
    scores = model.weights[rows[:, 0]].copy() if len(rows) else np.zeros((0, len(TAGS)))
    for k in range(1, FEATURES):
        scores += model.weights[rows[:, k]]
    tags = decode(scores, first, model.moves)
    at = np.flatnonzero(tags)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    row = np.searchsorted(first, at, "right") - 1
    kind = KIND[tags[at]]
    new = BEGINS[tags[at]].copy()
    new[0] = True
    new[1:] |= (np.diff(at) > 1) | (np.diff(row) > 0) | (np.diff(kind) != 0)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    return row[head], kind[head], start[at[head]] - offsets[row[head]], end[at[tail]] - offsets[row[head]]


def find_texts(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, start, end) of all findings, in bytes."""
    data, offs = B.buffers(column)
    parts = []
    for a, b in B.chunks(offs):
        row, *rest = spans(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], model)
        parts.append((row + a, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4


def _lines(seed: int, count: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled table: invented lines with the byte spans of what is personal."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    parts = "an er tion the re lo ka mi st eau ción ä ß ung qu ve or ñ é".split()
    word = lambda: "".join(pick(parts) for _ in range(rng.integers(1, 5)))
    plain = lambda: pick([str.lower, str.capitalize, str.upper, str.lower, str.lower])(word())
    number = lambda: pick(
        [d(1) + ".", d(1) + "." + d(1) + ".", d(2), d(4), d(1) + "." + d(1), f"{d(2)}:{d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(1)},{d(3)}", f"${d(2)}.{d(2)}", f'"{rng.bytes(20).hex()}"', f"v{d(1)}.{d(1)}.{d(2)}", d(3), d(5), f"{d(2)}%", f"#{d(4)}", f"{d(3)}-{d(2)}", rng.bytes(8).hex(), f"{d(2)}.{d(2)}.20{d(2)}", f"{d(1)}-{d(1)}", f"({d(4)})", d(8), f"{d(2)}:{d(2)}:{d(2)}", f"{d(3)} {d(3)}", f"{word()}:{d(3)}", f"{word()}{d(1)}", f"{word()}{d(2)}", f"{word()}-{d(3)}", f"{letters()}{d(2)}", f"{letters()}{d(3)}", f"{word()}'{word()[:1]}", f"https://{word()}.com/{word()}", f"{d(1)}::{d(1)}", f"{word()}::{word()}", f"{d(1)}.{d(3)}.{d(3)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(3)}-{d(4)}-X"]
    )
    host = lambda: pick([f"mail{d(1)}.example.com", f"{word()}.org", f"{word()}.{word()}.net", "example.com"])
    octet = lambda: str(rng.integers(0, 256))
    hexes = lambda: pick(["0000", ""]) or "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, pick([1, 2, 3, 4, 4, 4])))
    deep = lambda: ".".join([word() for _ in range(rng.integers(1, 3))] + [pick(["co.uk", "com.au", "de", "io", "ac.jp", "com", "com.mx", "localdomain"])])
    name = lambda: pick([word, lambda: word().capitalize()])()
    six = lambda: pick([lambda: ":".join(hexes() for _ in range(8)), lambda: ":".join(hexes() for _ in range(rng.integers(1, 4))) + "::" + ":".join(hexes() for _ in range(rng.integers(1, 4))), lambda: "fe80::" + hexes()])()
    letters = lambda: "".join(chr(65 + x) for x in rng.integers(0, 26, 2))
    make = {
        "EMAIL": lambda: pick([f"{name()}.{name()[:1]}'{name()}@{deep()}", f"{pick(['', '', 'href=', 'to='])}mailto:{name()}@{host()}", f"{name()}@{deep()}", f"{name()}_{name()}{d(2)}@{deep()}", f"{name()}.{name()}+{name()}@{name()}-{name()}.{pick(['no', 'org', 'eu'])}", f"{name()}.{name()}@{deep()}"]) if rng.random() < 0.3 else pick([f"{word()}.{d(2)}@{host()}", f"{word()}@{host()}", f"{word()}_{word()}@{host()}", f"{word()}.{word()}@{host()}", f"{word()}{d(2)}@{host()}", f"{word()}-{word()}@{host()}", f"{word()}+{word()}@{host()}", f"{word()}.{d(1)}@{host()}"]),
        "IP": lambda: six() if rng.random() < 0.3 else ".".join(octet() for _ in range(4)) + pick(["", "", "", f":{d(4)}", f":{d(2)}", "/24"]),
        "CARD": lambda: pick([d(16), d(16), d(15), " ".join(d(4) for _ in range(4)), "-".join(d(4) for _ in range(4)), f"{d(4)} {d(6)} {d(5)}", f"{d(4)}-{d(6)}-{d(5)}"]),
        "IBAN": lambda: pick([f"{letters()}{d(20)}", f"{letters()}{d(2)}{letters()}{letters()}{d(14)}", " ".join([letters() + d(2), *(d(4) for _ in range(rng.integers(3, 6))), d(2)]), " ".join([letters() + d(2), letters() + letters(), d(4), d(4), d(4), d(2)])]),
        "PHONE": lambda: pick([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)} {d(2)} {d(7)}", f"+{d(1)} {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}"]) if rng.random() < 0.6 else pick([f"0{d(3)} {d(3)} {d(4)}", f"+{d(2)} (0){d(2)} {d(6)}", f"+{d(2)} (0) {d(2)} {d(7)}", f"0{d(4)} {d(6)}", f"(0{d(2)}) {d(4)} {d(4)}", f"0{d(2)}-{d(7)}", f"+{d(2)}.{d(3)}.{d(3)}.{d(3)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{d(2)}{d(10)}", f"1-800-{d(3)}-{d(4)}"]),
        "SSN": lambda: f"{d(3)}-{d(2)}-{d(4)}",
    }
    lines = []
    for _ in range(count):
        junk = pick(["", "", "", "!!", "###", "***", "%%%", "$$$", "&&&", " |"])
        out, found = "", []
        for _ in range(rng.integers(1, 16)):
            kind = pick(KINDS) if rng.random() < 0.22 else None
            text = make[kind]() if kind else plain() if rng.random() < 0.75 else number()
            opening = pick(["", "", "", "", "", '"', "<", "["]) if kind in ("EMAIL", "IP", "CARD", "SSN", "IBAN") else ""
            pieces = text.split(" ")
            out += opening
            for i, piece in enumerate(pieces):
                start = len(out.encode())
                out += piece
                if kind and i == 0:
                    begin = start
                if kind and i == len(pieces) - 1:
                    found.append((begin, len(out.encode()), kind))
                out += junk if junk and rng.random() < 0.9 else pick(["", "", "", "", ".", ",", ";"]) if i == len(pieces) - 1 else ""
                out += pick([" ", " ", " ", "\n", "  "]) if i == len(pieces) - 1 else " "
        lines.append((out, found))
    return lines


def labelled(count: int = 2000, seed: int = 3) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The small labelled table that the model is trained on by default: (text, [(start, end, kind)]), in bytes."""
    return _lines(seed, count)


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 60, rate: float = 0.05, l2: float = 2e-4) -> Model:
    """Maximises the likelihood of the tags of all rows, by forward and backward sums over padded batches."""
    t = len(TAGS)
    data, offs = B.buffers(pa.array([x for x, _ in rows], pa.string()))
    ids, start, end, first = features(data, offs)
    gold = np.zeros(len(ids), np.int64)
    for r, (_, found) in enumerate(rows):
        own = slice(first[r], first[r + 1])
        for a, b, kind in found:
            hit = np.flatnonzero((start[own] < offs[r] + b) & (end[own] > offs[r] + a)) + first[r]
            gold[hit] = TAGS.index(f"I-{kind}") if f"I-{kind}" in TAGS else TAGS.index(f"B-{kind}")
            gold[hit[:1]] = TAGS.index(f"B-{kind}")
    size = np.diff(first)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    weights, moves = np.zeros((1 << BITS, t)), np.zeros((t, t))
    used = np.unique(ids)
    compact = np.searchsorted(used, ids)
    w = np.zeros((len(used), t))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    lse = lambda x, axis: np.log(np.exp(x - (m := x.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
    groups = []
    for length in np.unique(size[order]):
        own = order[size[order] == length]
        place = first[own][:, None] + np.arange(length)
        # where the gradient of each weight is gathered from: words by feature, in the order of features
        flat = compact[place].reshape(-1)
        turn = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(flat[turn]) != 0]))
        groups.append((length, own, place, turn // FEATURES, starts, flat[turn[starts]]))
    for epoch in range(1, epochs + 1):
        gw, gm = l2 * w * len(rows), l2 * moves * len(rows)
        for length, own, place, word, starts, ids_here in groups:
            e = w[compact[place]].sum(2)
            alpha, beta = np.empty_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for i in range(1, length):
                alpha[:, i] = lse(alpha[:, i - 1, :, None] + moves, 1) + e[:, i]
            for i in range(length - 2, -1, -1):
                beta[:, i] = lse(moves + (beta[:, i + 1] + e[:, i + 1])[:, None, :], 2)
            z = lse(alpha[:, -1], 1)
            p = np.exp(alpha + beta - z[:, None, None])
            y = gold[place]
            p[np.arange(len(own))[:, None], np.arange(length), y] -= 1
            gw[ids_here] += np.add.reduceat(p.reshape(-1, t)[word], starts, axis=0)
            for i in range(1, length):
                both = np.exp(alpha[:, i - 1, :, None] + moves + (beta[:, i] + e[:, i])[:, None, :] - z[:, None, None])
                gm += both.sum(0)
            np.subtract.at(gm, (y[:, :-1], y[:, 1:]), 1)
        for x, g, m, v in ((w, gw, state[0], state[1]), (moves, gm, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    weights[used] = w
    return Model(weights.astype(np.float32), moves.astype(np.float32))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, kind, start, end, value): one row for each finding; start and end count characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in B.small(batches):
            texts = batch.column(1)
            row, kind, start, end = find_texts(texts, shared.value)
            a, b, value, last = [], [], [], -1
            for r, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
                if r != last:  # findings come row by row; characters are counted once a row
                    raw, last = texts[r].as_py().encode(), r
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                a.append(int(chars[s]))
                b.append(int(chars[e]))
                value.append(raw[s:e].decode(errors="replace"))
            ids = batch.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array([KINDS[k] for k in kind], pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.string())], ["doc_id", "kind", "start", "end", "value"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind string, start long, end long, value string")


def mask_texts(column: pa.Array, model: Model) -> pa.Array:
    """The texts with ``[KIND]`` in place of each finding."""
    row, kind, start, end = find_texts(column, model)
    if not len(row):
        return column.cast(pa.string())
    texts = column.to_pylist()
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0, [True]]))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        raw, out, at = texts[row[a]].encode(), [], 0
        for k in range(a, b):
            out += [raw[at : start[k]], f"[{KINDS[kind[k]]}]".encode()]
            at = end[k]
        texts[row[a]] = b"".join([*out, raw[at:]]).decode(errors="replace")
    return pa.array(texts, pa.string())


def mask(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns, findings masked in ``text``, ``n_chars`` (where there is one) counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in B.small(batches):
            yield batch.set_column(at, "text", mask_texts(batch.column(at), shared.value))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding in the documents."""
    return find(table(spark, sf_dir, "documents"), train(labelled()))
