"""Plain Python versions of the operators, one text at a time, for the tests."""

import math
import re

import numpy as np
import zstandard

from quernmill.llm import bytescan as B
from quernmill.llm import components, decontaminate, langid, neardup, pii, quality, toxicity

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
FULL = 2**64


def words(text):
    return WORD.findall(text.lower())


def toxic_probability(text, model):
    """That of the highest window of words; a word's value is the mean weight of its n-grams in bytes."""
    values = []
    for word in words(text or ""):
        raw, found = b" " + word.encode() + b" ", []
        for n in toxicity.LENGTHS:
            for at in range(len(raw) - n + 1):
                h = sum(int(B.BYTE_CODE[raw[at + k]]) * pow(B.BASE, k, FULL) for k in range(n)) % FULL
                found.append(float(model.weights[((h + n) * 0x9E3779B97F4A7C15 % FULL) >> (64 - toxicity.BITS)]))
        values.append(sum(found) / max(1, len(found)))
    if not values:
        return 0.0
    size = min(model.window, len(values))
    best = max(sum(values[k : k + size]) / size for k in range(len(values) - size + 1))
    return 1 / (1 + math.exp(-min(50, max(-50, best + model.bias))))


def language(text, model):
    """The language whose dictionary encodes all pieces smallest, or und."""
    raw = (text or "").lower().encode()
    if not raw or not model.content:
        return langid.UNKNOWN
    plain = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in raw)
    need = []
    for content in model.content:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=langid.LEVEL)
        need.append(sum(len(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(plain[at : at + langid.PIECE])) for at in range(0, len(plain), langid.PIECE)))
    order = sorted(range(len(need)), key=lambda k: need[k])
    if len(order) == 1:
        return model.languages[0]
    more = need[order[1]] - need[order[0]]
    return model.languages[order[0]] if more >= langid.LEAST and more >= langid.MARGIN * len(raw) else langid.UNKNOWN


def good_probability(text, model):
    """Every filter at every other byte of every chunk; the mean and the greatest of the chunks' rectified maxima."""
    raw = (text or "").encode()
    if not raw:
        return 0.0
    half, filters = quality.HALF, model.tables.shape[2]
    halves = -(-(len(raw) + quality.TAPS) // half)
    raw = raw + bytes(halves * half + quality.TAPS - len(raw))
    chunks = []
    for c in range(max(1, halves - 1)):
        end = min(c + 2, halves) * half
        best = [-math.inf] * filters
        for at in range(c * half, end, quality.STRIDE):
            for f in range(filters):
                best[f] = max(best[f], sum(float(model.tables[j, raw[at + j], f]) for j in range(quality.TAPS)))
        chunks.append([max(0.0, b + float(model.intercept[f])) for f, b in enumerate(best)])
    mean = [sum(c[f] for c in chunks) / len(chunks) for f in range(filters)]
    top = [max(c[f] for c in chunks) for f in range(filters)]
    z = sum(x * float(w) for x, w in zip(mean + top, model.weights, strict=True)) + model.bias
    return 1 / (1 + math.exp(-min(50, max(-50, z))))


def smith_waterman(p, q):
    h = [[0] * (len(p) + 1) for _ in range(len(q) + 1)]
    for i in range(1, len(q) + 1):
        for j in range(1, len(p) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if q[i - 1] == p[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h)) / (2 * len(q))


def holds(text, item):
    """Whether a text shares a trigram with an item and aligns with it."""
    p, q = words(text or ""), words(item or "")
    grams = lambda w: set(zip(w, w[1:], w[2:], strict=False))
    return bool(grams(p) & grams(q)) and smith_waterman(p, q) >= decontaminate.THRESHOLD


def representatives(rows):
    """Ids that stay of (id, text) rows: the least of each set connected by comparing all pairs that share a band."""
    import pyarrow as pa

    sigs, has = neardup.sign_texts(pa.array([t for _, t in rows], pa.string()))
    short = (B.mix(sigs) >> B.U64(56)).astype(np.uint8)
    least = math.ceil(neardup.THRESHOLD * neardup.REGISTERS)
    bands = [slice(b * neardup.ROWS, (b + 1) * neardup.ROWS) for b in range(neardup.BANDS)]
    forest = components.Forest()
    for i in range(len(rows)):
        for j in range(i):
            if has[i] and has[j] and (rows[i] == rows[j] or any((sigs[i, b] == sigs[j, b]).all() for b in bands) and (short[i] == short[j]).sum() >= least):
                forest.join(i, j)
            elif rows[i] == rows[j]:
                forest.join(i, j)
    kept = {}
    for i, (d, _) in enumerate(rows):
        root = forest.find(i)
        kept[root] = min(kept.get(root, (True, 0)), (d is None, d if d is not None else 0))
    return sorted(d for _, d in kept.values())


def core(word):
    """Start and end of a word's core, in bytes."""
    alnum = [k for k, b in enumerate(word) if B.IS_WORD[b]]
    if not alnum:
        return 0, len(word)
    first, last = alnum[0], alnum[-1] + 1
    return (first - 1 if first and word[first - 1 : first] in (b"+", b"(") else first), last


def shapes(word):
    kind = "".join("9" if 48 <= b <= 57 else "a" if B.IS_WORD[b] else chr(b) for b in word)
    full = re.sub(r"a+", "a", kind)
    return full, re.sub(r"9+", "9", full), kind.count("9"), ("".join(sorted(re.sub(r"[a9]", "", kind))), "9" in kind, "a" in kind)


def masked(text, model, rows_of):
    """Text with findings replaced, by plain Viterbi over whole rows; rows_of gives feature rows of a text's words."""
    if not text:
        return text
    raw = text.encode()
    pieces = [(m.start(), m.end()) for m in re.finditer(rb"[^\t\n\x0b\x0c\r ]+", raw)]
    if not pieces:
        return text
    scores = np.array([sum(model.weights[f].astype(float) for f in row) for row in rows_of(raw)])
    tags = pii.viterbi(scores[None], model.moves.astype(float))[0]
    out, at, k = b"", 0, 0
    while k < len(pieces):
        if not tags[k]:
            k += 1
            continue
        end = k + 1
        while end < len(pieces) and tags[end] and not pii.BEGINS[tags[end]] and pii.KIND[tags[end]] == pii.KIND[tags[k]]:
            end += 1
        a = pieces[k][0] + core(raw[slice(*pieces[k])])[0]
        b = pieces[end - 1][0] + core(raw[slice(*pieces[end - 1])])[1]
        out, at = out + raw[at:a] + f"[{pii.KINDS[pii.KIND[tags[k]]]}]".encode(), b
        k = end
    return (out + raw[at:]).decode()
