"""The encoding, spelled out one payload at a time; what Spark's results are held against."""

import heapq
import math

PAIR = {"00": "GA", "01": "GT", "10": "CA", "11": "CT"}


def count(s, p):
    n, i = 0, s.find(p)
    while i >= 0:
        n, i = n + 1, s.find(p, i + len(p))
    return n


def longest(s, prefix):
    for n in range(len(s) // 2, 2, -1):
        if (s.find(s[:n], n) >= 0) if prefix else (s.find(s[-n:], 0, len(s) - n) >= 0):
            return n
    return 0


def segments(raw):
    bits = "".join(f"{b:08b}" for b in raw)
    return [bits[i : i + 500] for i in range(0, len(bits), 500)]


def table(segs):
    freq = {}
    for s in segs:
        if len(s) < 4:
            continue
        p, q = longest(s, True), longest(s, False)
        found = [s[:p]] if p >= 3 else []
        if q >= 3 and not (q <= p and s[-q:] == s[:q]):
            found.append(s[-q:])
        for x in found:
            freq[x] = freq.get(x, 0) + count(s, x)
    rows = sorted(freq.items(), key=lambda r: (-len(r[0]), -r[1], r[0]))
    top = rows[:512]
    if len(top) <= 1:
        return top
    deep = [r for r in top if len(r[0]) >= 2 * math.ceil(math.log2(len(top))) + 1]
    return deep or rows


def codes(rows):
    heap = [(f, k, x) for k, (x, f) in enumerate(rows)]
    heapq.heapify(heap)
    k = len(rows)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], k, (a[2], b[2])))
        k += 1
    out = {}

    def walk(node, code):
        if isinstance(node, tuple):
            for side, child in zip("GC" if len(code) % 2 == 0 else "AT", node):
                walk(child, code + side)
        elif len(code) >= 2:
            out[node] = code

    if heap:
        walk(heap[0][2], "")
    return out


def encode(segs, book):
    out, keys = [], sorted(book, key=len, reverse=True)
    for s in segs:
        i = 0
        while i < len(s):
            k = next((k for k in keys if s.startswith(k, i)), None)
            out.append(book[k] if k else PAIR[s[i : i + 2].ljust(2, "0")])
            i += len(k) if k else 2
    return "".join(out)
