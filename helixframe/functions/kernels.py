"""What takes Spark's own functions many interpreted steps for each segment or block, on whole Arrow columns: longest
repeats, greedy codes, runs of a base. Each is a row-local column; none holds more than a batch."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.constants import END_NT, MAX_END_GC, MAX_RUN, MIN_KEY_LEN, PAYLOAD_NT, SEGMENT_BITS

_PAIR = {"substr": pa.string(), "hits": pa.int64()}
_PROFILE = {"lp": pa.int32(), "ls": pa.int32(), "best_len": pa.int32(), "best_hits": pa.int64()}
#: Bits that are looked up in a table of all such numbers, and bits that are then sought among the keys' ranges.
_HEAD, _MORE = 15, 56
#: Segments that are searched side by side, so that their bits stay in a core's cache.
_SIDE = 512
#: Bytes of chunks that are encoded side by side, whole segments that begin and end with a byte; code tables that are told apart there.
_PIECE, _SIDE_BOOKS = 262 * 125, 1 << 64 - _MORE
_NONE = np.zeros(0, np.int64)


def _by_byte(words: list[tuple[str, str]]) -> np.ndarray:
    """A row of 8 letters for each byte: those of a 0 and a 1 at each of its bits, in turn."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    letters = np.array([[ord(x) for x in w] for w in words], np.uint8)
    return letters[np.arange(8) % len(words), bits]


_SPELLED = _by_byte([("0", "1")])
#: Two bits a pair of letters, for pairs that begin at even bits and at odd ones.
_PLAIN = (_by_byte([("G", "C"), ("A", "T")]), _by_byte([("A", "T"), ("G", "C")]))


def _eights(rows: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The row of 8 letters of each byte, one after the other."""
    return rows.view(np.uint64)[:, 0][data].view(np.uint8)


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


def longest_repeat(s: str, n: int = MIN_KEY_LEN) -> int:
    """Length of the longest prefix of s that occurs again without overlap; 0 if none has three bits. Each longer prefix
    is sought from where the last one was found, once that place holds no more of it. n: the least length that need be sought."""
    half, at = len(s) // 2, 0
    while n <= half:
        at = s.find(s[:n], max(at, n))
        if at < 0:
            break
        n += 1
        while n <= at and s[n - 1] == s[at + n - 1 : at + n]:
            n += 1
    return n - 1 if n > MIN_KEY_LEN else 0


def repeats_of(s: str) -> tuple[int, int]:
    """Longest repeating prefix and suffix: a suffix is a prefix of the text reversed."""
    return longest_repeat(s), longest_repeat(s[::-1])


@functools.lru_cache(16)
def _rooms(size: int, wide: int) -> np.ndarray:
    """For each distance ones from the bit on that a repeat at it may not reach, of `wide` bits; all where there is none."""
    at = np.arange(size)
    room = np.minimum(at, size - at)
    ones = (1 << wide) - 1
    return np.array([ones if n < MIN_KEY_LEN else ones >> min(n, wide) for n in room.tolist()], f"u{wide // 8}")


def _leading(least: np.ndarray, wide: int) -> np.ndarray:
    """Zeros before the first one of numbers of `wide` bits."""
    return wide - np.bitwise_count(_filled(least, wide)).astype(np.int64)


def _filled(x: np.ndarray, wide: int) -> np.ndarray:
    """Ones from the first one on."""
    k = 1
    while k < wide:
        x = x | x >> x.dtype.type(k)
        k *= 2
    return x


def _longest_prefixes(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """longest_repeat() of texts of one length, side by side (a row for each place), and how often it occurs without overlap (-1: not counted here).
    At each distance the first 16 bits of a text are held against those that stand there; the place of the first that differs is the length,
    which neither the distance nor the text's end may exceed. Only where all 16 recur, more are looked at: 64 first, and if these recur as well the
    text is searched by itself."""
    size, n = bits.shape
    eight, other = np.zeros((2, size + 64, n), np.uint8)  # the byte that begins at each place
    eight[:size] = bits
    for k in (1, 2, 4):
        np.multiply(eight, np.uint8(1 << k), out=other)
        other[:-k] |= eight[k:]
        eight, other = other, eight
    apart = eight[:size].astype(np.uint16)
    apart *= np.uint16(256)
    apart |= eight[8 : size + 8]
    apart ^= apart[0].copy()
    edge = min(16, size)
    rooms = _rooms(size, 16)[:, None]
    least = np.minimum((apart[:edge] | rooms[:edge]).min(axis=0), (apart[-edge:] | rooms[-edge:]).min(axis=0))
    if size > 2 * edge:
        np.minimum(least, apart[edge:-edge].min(axis=0), out=least)
    length = _leading(least, 16)
    length[length < MIN_KEY_LEN] = 0
    # Places at which as many bits stand, 16 at most, text by text.
    found = np.flatnonzero(apart < np.where(length > 0, 1 << 16 - length, 0).astype(np.uint16))
    at, text = np.divmod(found, n)
    place = np.sort(text * size + at)
    text, at = np.divmod(place, size)
    many = least == 0
    more = np.flatnonzero(many[text])
    if len(more):
        own, inside = text[more], at[more]
        first, here = np.zeros(len(more), np.uint64), np.zeros(len(more), np.uint64)
        for k in range(0, 64, 8):
            first = first << np.uint64(8) | eight[k, own]
            here = here << np.uint64(8) | eight[inside + k, own]
        here ^= first
        texts = np.flatnonzero(many)
        least = np.minimum.reduceat(here | _rooms(size, 64)[inside], np.searchsorted(own, texts))
        length[texts] = _leading(least, 64)
        for k in texts[least == 0].tolist():
            length[k] = _longest_slid(eight[: size - 7, k].tobytes().decode("latin-1"))
        alike = np.ones(len(text), bool)
        alike[more] = here >> np.maximum(64 - length[own], 0).astype(np.uint64) == 0
        place, text, at = place[alike], text[alike], at[alike]
    fits = at + length[text] <= size
    place, text = place[fits], text[fits]
    return length, np.where(length > 64, -1, _without_overlap(place, text, length, size))


def _without_overlap(place: np.ndarray, text: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """How many of the places of each text are taken, in order, if those that begin within the one before are left out."""
    after = np.searchsorted(place, place + length[text])  # the next that may stand beside each
    here = np.searchsorted(place, np.arange(len(length)) * size)
    count, own = np.zeros(len(length), np.int64), np.arange(len(length))
    while len(own):
        inside = here < len(place)
        own, here = own[inside], here[inside]
        inside = text[here] == own
        own, here = own[inside], here[inside]
        count[own] += 1
        here = after[here]
    return count


def _longest_slid(slid: str) -> int:
    """longest_repeat() of a text of which the first 64 bits recur, by its sliding bytes."""
    low, high = 64, (len(slid) + 7) // 2
    while low < high:  # what holds of a length holds of all shorter ones
        n = (low + high + 1) // 2
        low, high = (n, high) if slid.find(slid[: n - 7], n) >= 0 else (low, n - 1)
    return low


def repeats_side_by_side(bits: np.ndarray) -> tuple[list[int], list[int]]:
    """repeats_of() of texts of one length, a row of bits each."""
    return tuple(_counted_side_by_side(bits)[:2])


def _counted_side_by_side(bits: np.ndarray) -> list[list[int]]:
    """repeats_of() of texts of one length, a row of bits each, and how often each repeat occurs (-1: not counted here)."""
    found: list[list[int]] = [[], [], [], []]
    for a in range(0, len(bits), _SIDE):
        own = np.ascontiguousarray(bits[a : a + _SIDE].T)
        lp, np_hits = _longest_prefixes(own)
        ls, ns_hits = _longest_prefixes(own[::-1])  # as many of a suffix fit from the right as from the left
        for into, x in zip(found, (lp, ls, np_hits, ns_hits), strict=True):
            into += x.tolist()
    return found


def _found(raws: list[bytes]) -> Iterator[tuple[str, list[int], list[int], list[int], list[int]]]:
    """Bits of each chunk of whole segments, and of each of its segments the longest repeating prefix, suffix, and occurrences of each."""
    bits = [bits_of(x) for x in raws]
    whole = [len(b) // SEGMENT_BITS for b, _ in bits]
    found = _counted_side_by_side(np.concatenate([np.zeros((0, SEGMENT_BITS), np.uint8), *[b[: n * SEGMENT_BITS].reshape(n, SEGMENT_BITS) for (b, _), n in zip(bits, whole, strict=True)]]))
    end = 0
    for (_, text), n in zip(bits, whole, strict=True):
        begin, end = end, end + n
        lp, ls, first, last = (x[begin:end] for x in found)
        rest = text[n * SEGMENT_BITS :]
        if rest:
            for into, x in zip((lp, ls, first, last), (*repeats_of(rest), -1, -1), strict=True):
                into.append(x)
        for k in {k for own in (first, last) for k, x in enumerate(own) if x < 0}:
            s = text[k * SEGMENT_BITS : (k + 1) * SEGMENT_BITS]
            for into, size, sought in ((first, lp[k], s[: lp[k]]), (last, ls[k], s[len(s) - ls[k] :])):
                if into[k] < 0:
                    into[k] = s.count(sought) if size else 0
        yield text, lp, ls, first, last


def found_in(raws: list[bytes]) -> Iterator[list[tuple[str, int, int, int, int]]]:
    """(segment, longest repeating prefix, suffix, occurrences of each) of each segment of each chunk of whole segments."""
    for text, *own in _found(raws):
        yield list(zip(segments_of(text), *own, strict=True))


def sliding_bits(s: str) -> str:
    """sliding() of a text of bits, without places that have fewer than eight."""
    bits = np.frombuffer(s.encode("ascii"), np.uint8) & 1
    return np.packbits(np.lib.stride_tricks.sliding_window_view(bits, 8), axis=1).tobytes().decode("latin-1") if len(bits) > 7 else ""


def sliding(raw: bytes) -> str:
    """At each bit the byte that begins there, as a letter: texts of 256 letters are searched several times as fast as texts of two."""
    wide = np.frombuffer(raw + b"\0", np.uint8).astype(np.uint16)
    wide = wide[:-1] << 8 | wide[1:]
    out = np.empty((len(wide), 8), np.uint8)
    for r in range(8):
        out[:, r] = wide >> np.uint16(8 - r)
    return out.tobytes().decode("latin-1")


def count_of(s: str, slid: str, at: int, size: int) -> int:
    """s.count(s[at : at + size]), by the sliding bytes of s."""
    if size < 8:
        return s.count(s[at : at + size])
    sought, n, place = slid[at : at + size - 7], 0, slid.find(slid[at : at + size - 7])
    while place >= 0:
        n, place = n + 1, slid.find(sought, place + size)
    return n


def entries(s: str, lp: int, ls: int, first: int, last: int) -> list[tuple[str, int]]:
    """(substr, hits) of a segment: its repeating prefix, and suffix unless it is a prefix no longer than that."""
    if len(s) <= MIN_KEY_LEN:
        return []
    out = [(s[:lp], first)] if lp >= MIN_KEY_LEN else []
    if ls >= MIN_KEY_LEN and not (ls <= lp and s.endswith(s[:ls])):
        out.append((s[len(s) - ls :], last))
    return out


def bits_of(raw: bytes) -> tuple[np.ndarray, str]:
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))
    return bits, (bits + 48).tobytes().decode()


def spelled(raws: pa.Array) -> pa.Array:
    """Binaries as '0' and '1', most significant bit first; null for null."""
    return pa.array([None if x is None else _eights(_SPELLED, np.frombuffer(x, np.uint8)).tobytes().decode() for x in raws.to_pylist()], pa.string())


def segments_of(text: str) -> list[str]:
    return [text[i : i + SEGMENT_BITS] for i in range(0, len(text), SEGMENT_BITS)]


@F.arrow_udf(_struct(lp=T.IntegerType(), ls=T.IntegerType()))
def repeats(s: pa.Array) -> pa.Array:
    texts = s.to_pylist()
    found: list = [None if x is None or len(x) == SEGMENT_BITS else repeats_of(x) for x in texts]
    whole = [k for k, x in enumerate(texts) if x is not None and len(x) == SEGMENT_BITS]
    rows = np.frombuffer("".join(texts[k] for k in whole).encode("ascii"), np.uint8).reshape(-1, SEGMENT_BITS)
    for k, *own in zip(whole, *repeats_side_by_side(rows & 1), strict=True):
        found[k] = own
    found = [(None, None) if x is None else x for x in found]
    return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)], ["lp", "ls"])


def _lists(rows: list[list], kinds: dict[str, pa.DataType]) -> pa.Array:
    """Lists of structs, from rows of tuples."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    flat = [x for row in rows for x in row]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array([x[k] for x in flat], kind) for k, kind in enumerate(kinds.values())], list(kinds)))


def chunk_tables(raws: list[bytes]) -> tuple[list[int], list[dict[str, int]]]:
    """Of chunks of whole segments: the sum of their best lengths, and their entries(), hits summed."""
    sums, tables = [], []
    for text, lp, ls, first, last in _found(raws):
        hits: dict[str, int] = {}
        for at, p, q, n, m in zip(range(0, len(text), SEGMENT_BITS), lp, ls, first, last, strict=True):
            if p:
                x = text[at : at + p]
                hits[x] = hits.get(x, 0) + n
            if q:
                end = min(at + SEGMENT_BITS, len(text))
                x = text[end - q : end]
                if q > p or not text.startswith(x, at):
                    hits[x] = hits.get(x, 0) + m
        sums.append(sum(map(max, lp, ls)))
        tables.append(hits)
    return sums, tables


def chunk_repeats(chunks: pa.Array) -> list[pa.Array]:
    """chunk_tables() as columns."""
    sums, tables = chunk_tables(chunks.to_pylist())
    return [pa.array(sums, pa.int64()), _lists([list(x.items()) for x in tables], _PAIR)]


def chunk_profiles(chunks: pa.Array) -> list[pa.Array]:
    """Of chunks of whole segments: each segment's repeats, the longer one's length and its occurrences (0 under four bits)."""
    rows = []
    for own in found_in(chunks.to_pylist()):
        row = []
        for s, lp, ls, first, last in own:
            best = max(lp, ls) if len(s) > MIN_KEY_LEN else 0
            slid = sliding_bits(s) if best and lp != ls else ""
            ends = (first if lp == best else count_of(s, slid, 0, best), last if ls == best else count_of(s, slid, len(s) - best, best)) if best else (0, 0)
            row.append((lp, ls, best, max(ends)))
        rows.append(row)
    return [_lists(rows, _PROFILE)]


def chunk_entries(chunks: pa.Array) -> list[pa.Array]:
    """Of chunks of whole segments: the entries of all segments, one by one."""
    return [_lists([[e for x in own for e in entries(*x)] for own in found_in(chunks.to_pylist())], _PAIR)]


class Book:
    """Keys and codes of a code table, sorted so that the longest key that stands at a place is found for all places at once. A key of
    up to _MORE bits is a range of the numbers that so many bits spell; ranges lie within each other or apart, so that the innermost one around a
    number is the last that begins before it, or one around that. Longer keys with the same first bits are one range, and are told apart by
    all their bits, the same way."""

    def __init__(self, keys: list[str], codes: list[str]):
        nodes: list[tuple[str, int]] = []  # first bits, and the key's number; -1: longer keys begin with them
        longer: list[tuple[str, int]] = []
        for key, k in sorted(zip(keys, range(len(keys)), strict=True)):
            if len(key) <= _MORE:
                nodes.append((key, k))
                continue
            if not nodes or nodes[-1] != (key[:_MORE], -1):
                nodes.append((key[:_MORE], -1))
            longer.append((key, k))
        self.number = np.array([k for _, k in nodes], np.int64)
        self.low = np.array([int(x, 2) << _MORE - len(x) for x, _ in nodes], np.uint64)
        self.width = np.array([1 << _MORE - len(x) for x, _ in nodes], np.uint64)
        around = _around([x for x, _ in nodes])
        self.around = np.array(around, np.int64)
        heads = [(a >> _MORE - _HEAD, (a + n - 1 >> _MORE - _HEAD) + 1) for a, n, top in zip(self.low.tolist(), self.width.tolist(), around, strict=True) if top < 0]
        self.single = np.array([a for a, z in heads if z == a + 1], np.int64)  # first bits that all begin a key, one by one or in runs
        self.runs = [x for x in heads if x[1] > x[0] + 1]
        self.size = np.array([*map(len, keys), 0], np.int64)  # the last one: of no key
        self.bytes = -(-max((len(x) for x, _ in longer), default=0) // 8)
        edge = lambda bit: np.array([int(x.ljust(8 * self.bytes, bit), 2).to_bytes(self.bytes) for x, _ in longer], f"S{self.bytes or 1}")
        self.first, self.last = edge("0"), edge("1")
        self.long_number = np.array([k for _, k in longer], np.int64)
        self.long_around = np.array(_around([x for x, _ in longer]), np.int64)
        self.code_size = np.array([*map(len, codes), 0], np.int64)
        self.letters = "".join(codes).encode("ascii")

    def _longer(self, padded: np.ndarray, place: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Numbers of the longest keys of more than _MORE bits at places, -1 where none stands."""
        out = np.full(len(place), -1)
        data = np.concatenate((padded, np.zeros(self.bytes, np.uint8)))
        for a in range(0, len(place), _SIDE):
            own = place[a : a + _SIDE]
            rows = data[(own >> 3)[:, None] + np.arange(self.bytes + 1)].astype(np.uint16)
            rows = (((rows[:, :-1] << 8 | rows[:, 1:]) << (own & 7).astype(np.uint16)[:, None]) >> 8).astype(np.uint8).view(self.first.dtype).ravel()
            node = np.searchsorted(self.first, rows, "right") - 1
            left = np.flatnonzero(node >= 0)
            while len(left):
                here = node[left]
                fits = (rows[left] <= self.last[here]) & (self.size[self.long_number[here]] <= room[a + left])
                out[a + left[fits]] = self.long_number[here[fits]]
                node[left] = self.long_around[here]
                left = left[~fits & (node[left] >= 0)]
        return out


def _numbered(books: list[Book]) -> tuple[list[Book], np.ndarray]:
    """Books, each once, and the number of each given one among them."""
    own = list({id(x): x for x in books}.values())
    number = {id(x): k for k, x in enumerate(own)}
    return own, np.array([number[id(x)] for x in books], np.int64)


def _before(sizes) -> np.ndarray:
    """Sums of what comes before each."""
    return np.cumsum(sizes) - sizes


def matches(raws: list[bytes], books: list[Book]) -> tuple[np.ndarray, ...]:
    """Places (bits, of all chunks one after the other) at which a key of the chunk's book stands that fits in its segment, the number of the place's chunk, and
    the longest such key's number in its book. All chunks are looked at side by side: a book's nodes stand in a table of all books' nodes, by its number."""
    own, book = _numbered(books)
    nodes = [len(x.low) for x in own]
    if not any(nodes):
        return _NONE, _NONE, _NONE
    known = np.zeros((len(own), 1 << _HEAD), bool)
    for k, x in enumerate(own):
        known[k, x.single] = True
        for a, z in x.runs:
            known[k, a:z] = True
    known = known.ravel()
    joined = lambda c: np.concatenate([getattr(x, c) for x in own])
    node_book = np.repeat(np.arange(len(own)), nodes)
    first_node = _before(nodes)
    low, width, node_key, around = joined("low") + (node_book.astype(np.uint64) << np.uint64(_MORE)), joined("width"), joined("number"), joined("around")
    around = np.where(around < 0, -1, around + first_node[node_book])
    size = joined("size")  # of a book's keys and of none
    first_key = _before([len(x.size) for x in own])
    node_size = np.where(node_key < 0, 0, size[first_key[node_book] + node_key])
    sizes = np.array([len(x) for x in raws], np.int64)
    begin = _before(sizes)
    data = np.frombuffer(b"".join(raws) + bytes(9), np.uint8)
    wide = data.astype(np.uint32)
    wide = (wide[:-9] << np.uint32(16)) | (wide[1:-8] << np.uint32(8)) | wide[2:-7]
    at_book = np.repeat((book << _HEAD).astype(np.uint32), sizes)
    stands, mask = np.empty((len(wide), 8), bool), np.uint32((1 << _HEAD) - 1)
    for r in range(8):
        stands[:, r] = np.take(known, (wide >> np.uint32(24 - _HEAD - r) & mask) + at_book, mode="clip")
    place = np.flatnonzero(stands)
    at, by = place >> 3, (place & 7).astype(np.uint64)
    chunk = np.repeat(np.arange(len(raws)), sizes)[at]
    inside = place - 8 * begin[chunk]
    room = np.minimum(8 * sizes[chunk], (inside // SEGMENT_BITS + 1) * SEGMENT_BITS) - inside
    eight = np.ndarray(len(wide) + 1, ">u8", data, strides=(1,))
    bits = (eight[at].astype(np.uint64) << by | data[at + 8].astype(np.uint64) >> (np.uint64(8) - by)) >> np.uint64(64 - _MORE)
    bits |= book[chunk].astype(np.uint64) << np.uint64(_MORE)
    node = np.searchsorted(low, bits, "right") - 1
    here = (node >= 0) & (bits - low[node] < width[node])
    key = node_key[node]
    found = np.where(here & (key >= 0) & (node_size[node] <= room), key, -1)
    many = np.flatnonzero(here & (key < 0))
    if len(many):
        cuts = np.searchsorted(many, np.searchsorted(chunk, np.arange(len(raws) + 1)))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            some = many[cuts[k] : cuts[k + 1]]
            found[some] = books[k]._longer(data[begin[k] : begin[k] + sizes[k] + 9], place[some] - 8 * begin[k], room[some])
    # Where none stands or fits, one around it may.
    left = np.flatnonzero((found < 0) & (node >= 0))
    node = around[node[left]]
    while len(left := left[node >= 0]):
        node = node[node >= 0]
        key = node_key[node]  # longer keys have no others around them but shorter ones
        fits = (bits[left] - low[node] < width[node]) & (node_size[node] <= room[left])
        found[left[fits]] = key[fits]
        left, node = left[~fits], around[node[~fits]]
    some = np.flatnonzero(found >= 0)
    return place[some], chunk[some], found[some]


def _around(texts: list[str]) -> list[int]:
    """For each of sorted texts the number of the longest other one that it begins with, -1 if none."""
    out, above = [], []
    for k, x in enumerate(texts):
        while above and not x.startswith(texts[above[-1]]):
            above.pop()
        out.append(above[-1] if above else -1)
        above.append(k)
    return out


def greedy(raws: list[bytes], books: list[Book]) -> tuple[np.ndarray, np.ndarray]:
    """Nucleotides of chunks, each by its book, one after the other, and the end of each segment's among them. At each place stands the longest key that fits in the segment, else two bits. The walk from key to key takes a step
    in all segments at once; what lies between keys is cut out of the two-bit code of either alignment."""
    data = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([8 * len(x) for x in raws], np.int64)
    base = np.cumsum(sizes) - sizes
    count = -(-sizes // SEGMENT_BITS)
    last = np.cumsum(count)
    ends = np.repeat(base, count) + np.minimum((np.arange(count.sum()) - np.repeat(last - count, count) + 1) * SEGMENT_BITS, np.repeat(sizes, count))
    place, chunk, key = matches(raws, books)
    of = (place - base[chunk]) // SEGMENT_BITS + (last - count)[chunk]
    own, book = _numbered(books)
    key = key + _before([len(x.size) for x in own])[book][chunk]
    length, code_size = (np.concatenate([getattr(x, c) for x in own]) for c in ("size", "code_size"))
    length, code, code_size = length[key], (2 * len(data) * 8 + _before(code_size))[key], code_size[key]
    source = np.concatenate([*(_eights(x, data) for x in _PLAIN), np.frombuffer(b"".join(x.letters for x in own) + b"A", np.uint8)])
    taken = _walked(place, place + length, of, ends)
    place, of, length, code, code_size = (x[taken] for x in (place, of, length, code, code_size))
    # What follows each other: a key with the plain bits before it, and the plain bits at the end of a segment, with an A if there is a lone one.
    total = len(place) + len(ends)
    keys_at, ends_at = np.arange(len(place)) + of, np.searchsorted(place, ends) + np.arange(len(ends))
    begin, stop = np.empty(total, np.int64), np.zeros(total + 1, np.int64)
    begin[keys_at], begin[ends_at] = place, ends
    stop[keys_at + 1], stop[ends_at + 1] = place + length, ends
    stop = stop[:-1]  # where the one before ended
    source_at, size = np.empty((total, 2), np.int64), np.empty((total, 2), np.int64)
    source_at[:, 0], size[:, 0] = stop + (stop & 1) * (len(data) * 8), begin - stop
    source_at[keys_at, 1], size[keys_at, 1] = code, code_size
    source_at[ends_at, 1], size[ends_at, 1] = len(source) - 1, (begin - stop)[ends_at] & 1
    size, source_at = size.ravel(), source_at.ravel()
    done = np.cumsum(size)
    index = np.repeat(source_at - done + size, size)
    index += np.arange(len(index))
    return source[index], done[1::2][ends_at]


def _walked(place: np.ndarray, stop: np.ndarray, of: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the keys that stand at places, in order, are taken: from a segment's beginning, or a key's end, the next one at an even distance. of:
    places' segments."""
    if not len(place):
        return _NONE
    # For each place the next key at an even distance from it, by those at even places and at odd ones.
    n, following = int(ends[-1]) + 1, []
    for odd in (0, 1):
        side = np.flatnonzero((place & 1) == odd)
        following.append(np.repeat(np.append(side, -1).astype(np.int32), np.diff(place[side], prepend=-1, append=n - 1)))
    following = np.concatenate(following)
    after = following[stop + (stop & 1) * n]
    after[of[after] != of] = -1
    begin = np.concatenate(([0], ends[:-1]))  # segments begin at even places
    here = following[begin]
    here[of[here] != np.arange(len(ends))] = -1
    taken = np.zeros(len(place), bool)
    while len(here := here[here >= 0]):
        taken[here] = True
        here = after[here]
    return np.flatnonzero(taken)


def encoded_rows(raws: list[bytes], books: Iterable[Book], listed: bool) -> pa.Array:
    """The nucleotides of each chunk, by its book; listed: a list of those of each segment. Some chunks, or pieces of whole segments of a long one,
    are worked on side by side."""
    letters, cuts, held, size, drawn = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)], [], 0, 0
    for raw, book in itertools.chain(zip(raws, books, strict=True), [(None, None)]):
        for a in range(0, len(raw), _PIECE) if raw is not None else [0]:
            piece = None if raw is None else raw[a : a + _PIECE]
            if held and (piece is None or size + len(piece) > _PIECE or len(held) == _SIDE_BOOKS):
                own, ends = greedy(*map(list, zip(*held, strict=True)))
                letters.append(own)
                cuts.append(ends + drawn)
                held, size, drawn = [], 0, drawn + len(own)
            if piece is not None:
                held.append((piece, book))
                size += len(piece)
    cuts = np.concatenate(cuts).astype(np.int32)
    rows = np.cumsum([0, *[-(-8 * len(x) // SEGMENT_BITS) for x in raws]]).astype(np.int32)
    own = pa.py_buffer(np.concatenate(letters))
    if listed:
        return pa.ListArray.from_arrays(pa.array(rows), pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), own))
    return pa.StringArray.from_buffers(len(raws), pa.py_buffer(np.ascontiguousarray(cuts[rows])), own)


def coder(keys: list[str], codes: list[str]) -> Callable[[bytes], list[str]]:
    """A function from bytes to the nucleotides of each of their segments."""
    book = Book(keys, codes)
    return lambda raw: encoded_rows([raw], [book], True)[0].as_py()


@F.arrow_udf(T.ArrayType(T.StringType()))
def encode_bytes(payload: pa.Array, keys: pa.Array, codes: pa.Array) -> pa.Array:
    """Nucleotides of each segment of a payload, or of a chunk of whole segments; null where there is none."""
    out, last, run = [], None, None
    for raw, k, v in zip(payload.to_pylist(), keys, codes, strict=True):
        book = (k.as_py() or [], v.as_py() or [])
        if run is None or book != last:
            run, last = coder(*book), book
        out.append(None if raw is None else run(raw))
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(_struct(gc=T.IntegerType(), rll=T.IntegerType(), endgc=T.IntegerType()))
def checks(block: pa.Array) -> pa.Array:
    """G or C among a block's bases and among its last ones, and its longest run of one base (1 at least)."""
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in check_columns(block.to_pylist())], ["gc", "rll", "endgc"], mask=block.is_null())


def check_columns(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gc, rll and endgc of checks()."""
    data = np.frombuffer("".join(x or "" for x in texts).encode("ascii", "replace"), np.uint8)
    return checks_of(data, np.cumsum([len(x or "") for x in texts], dtype=np.int64))


def checks_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gc, rll and endgc of texts that lie one after the other, each up to its end."""
    at = np.concatenate(([0], ends))[:-1]
    strong = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data == ord("G")) | (data == ord("C")), out=strong[1:])
    rll = np.ones(len(ends), np.int64)
    some = np.flatnonzero(ends > at)
    if len(some):
        new = np.empty(len(data), bool)
        np.not_equal(data[1:], data[:-1], out=new[1:])
        new[at[some]] = True
        runs = np.flatnonzero(new)
        lengths = np.diff(runs, append=len(data))
        rll[some] = np.maximum.reduceat(lengths, np.searchsorted(runs, at[some]))
    return strong[ends] - strong[at], rll, strong[ends] - strong[np.maximum(at, ends - END_NT)]


def _cuts(dna: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts, one after the other; where pieces of 120 of them begin, with the end of all; and the number of pieces before each text,
    with that of all. A null has none."""
    size = pc.fill_null(pc.binary_length(dna), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    own = pc.fill_null(dna, "").cast(pa.string())
    offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int32)
    data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(own) else np.zeros(0, np.uint8)
    count = -(-size // PAYLOAD_NT)
    first = np.cumsum(size) - size
    begin = np.repeat(first - (np.cumsum(count) - count) * PAYLOAD_NT, count) + np.arange(count.sum()) * PAYLOAD_NT
    return data, np.concatenate((begin, [size.sum()])), np.concatenate(([0], np.cumsum(count))).astype(np.int32)


def tiles(dna: pa.Array) -> pa.Array:
    """Pieces of 120 nucleotides in order, the last one may be short: a list a text, cut out of all texts' bytes at once."""
    data, cuts, before = _cuts(dna)
    return pa.ListArray.from_arrays(pa.array(before), pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))))


def var_pop(numbers: list[float]) -> float:
    """Variance by the steps that Spark's var_pop takes, so that it is rounded alike where its digits end in a five."""
    n = mean = squares = 0.0
    for x in numbers:
        n += 1.0
        apart = x - mean
        step = apart / n
        mean += step
        squares += apart * (apart - step)
    return squares / n


#: What block_sums() says of a text, with its types.
BLOCK_SUMS = "gc_mean double, gc_var double, rll_max long, rll_violations long, end_violations long, storage_seq_count long, nt long"


def block_sums(dna: pa.Array) -> list[pa.Array]:
    """Of texts of bases, none of them empty, what a summary of the checks() of tiles() says of each: 64 bases' bits are a number, so that a block is two of them."""
    data, cuts, before = _cuts(dna)
    n, ends = len(cuts) - 1, cuts[before[1:]].tolist()
    size, rows = np.diff(cuts), np.full((n, 128), ord("A"), np.uint8)
    for a, z, begin, end in zip(before[:-1].tolist(), before[1:].tolist(), [0, *ends[:-1]], ends, strict=True):
        whole = (end - begin) // PAYLOAD_NT
        rows[a : a + whole, :PAYLOAD_NT] = data[begin : begin + whole * PAYLOAD_NT].reshape(whole, PAYLOAD_NT)
        if a + whole < z:
            rows[z - 1, : end - begin - whole * PAYLOAD_NT] = data[begin + whole * PAYLOAD_NT : end]
    one, ones = np.uint64(1), ~np.uint64(0)
    inside = [np.where(size > a, ones >> np.clip(a + 64 - size, 0, 63).astype(np.uint64), ones ^ ones) for a in (0, 64)]
    strong, other = (np.ascontiguousarray(np.packbits(rows & np.uint8(b), axis=1, bitorder="little").view("<u8").T) for b in (2, 4))  # C and G; G and T
    gc = (np.bitwise_count(strong[0]).astype(np.int64) + np.bitwise_count(strong[1])).astype(np.int64)
    tail = np.maximum(size - END_NT, 0).astype(np.uint64)
    last = np.where(tail < 64, strong[0] >> np.minimum(tail, 63) | strong[1] << one << (np.uint64(63) - np.minimum(tail, 63)), strong[1] >> (np.maximum(tail, 64) - np.uint64(64)))
    endgc = np.bitwise_count(last & np.uint64((1 << END_NT) - 1))
    turned = lambda x: (x[0] ^ x[0] << one, x[1] ^ (x[1] << one | x[0] >> np.uint64(63)))
    alike = [~(x | y) & z for x, y, z in zip(turned(strong), turned(other), inside, strict=True)]  # bases that are as the one before them
    alike[0] &= ~one
    rll, own = np.ones(n, np.int64), np.arange(n)
    while len(own):
        some = np.flatnonzero(alike[0] | alike[1])
        own, low, high = own[some], alike[0][some], alike[1][some]
        rll[own] += 1
        alike = [low & low << one, high & (high << one | low >> np.uint64(63))]
    first, count = before[:-1], np.diff(before).astype(np.int64)
    share = gc / float(PAYLOAD_NT)
    mean = np.bincount(np.repeat(np.arange(len(count)), count), share, len(count)) / count
    share = share.tolist()
    spread = [var_pop(share[a:z]) for a, z in itertools.pairwise(before.tolist())]
    over = lambda x, most: np.add.reduceat((x > most).astype(np.int64), first)
    return [pa.array(x) for x in (mean, spread, np.maximum.reduceat(rll, first), over(rll, MAX_RUN), over(endgc, MAX_END_GC), count, np.add.reduceat(size, first))]
