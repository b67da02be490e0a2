"""Plain versions of the contracts, straight from their wording, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


PHRASES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licences(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(words))
             if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in found})))


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    text = text or ""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                          ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    n = Counter(k for k, _, _ in out)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in out)
    return (n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest()), out


def fingerprint(text):
    import xxhash

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=3):
    """{doc_id: component} from {doc_id: fingerprint}."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def repeated(texts, size=200):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(hash(d[i:i + size]) for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if count[hash(d[i:i + size])] > 1:
                gone[i:i + size] = b"\x01" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def merkle(rows, arity=16):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)] of rows (doc_id, source, lang, n_chars, text)."""
    import zlib

    def h(x):
        return hashlib.sha256(x.encode()).hexdigest()

    def leaf(row):
        return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))

    def tree(nodes):
        """Root, and for each leaf the list of (before, after)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                r = k // arity * arity
                paths[i].append(("".join(nodes[r:k]), "".join(nodes[k + 1:r + arity])))
            nodes = [h("".join(nodes[i:i + arity])) for i in range(0, len(nodes), arity)]
            at = [k // arity for k in at]
        return nodes[0], paths

    by = {}
    for row in rows:
        by.setdefault(row[1], []).append((row, leaf(row)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    found = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        found[s] = tree([x for _, x in by[s]])
    root, above = tree([found[s][0] for s in order])
    out = []
    for s, top in zip(order, above):
        for (row, own), path in zip(by[s], found[s][1]):
            steps = path + top
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                node = leaf((*row[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])))
            for b, a in steps:
                node = h(b + node + a)
            out.append((row[0], own, found[s][0], root, h("".join(b + a for b, a in steps)), node, node == root))
    return out


def spelling(rows):
    """[(word, form, root, n, n_near, form_n)] of rows (doc_id, text)."""
    import zlib

    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    form, n_near = {}, {}
    for w, n in words.items():
        found = [x for k in (-1, 0, 1) for x in by.get(len(w) + k, []) if near(w, x)]
        n_near[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], words.get(form[w])))
    return out


def lm(rows, kappa=2.0):
    """{index: (held_out, n_tokens, n_known, N, base_score, score from exact counts)} of rows (doc_id, text)."""
    import math
    import zlib

    def tokens(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return WORD.findall(text) + ["\n"]

    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    one, two, docs = Counter(), Counter(), 0
    for (_, text), out in zip(rows, held):
        if not out:
            t = tokens(text)
            one.update(t)
            two.update(zip([None, *t], t))
            docs += 1
    n, v = sum(one.values()), len(one)
    result = []
    for (_, text), out in zip(rows, held):
        t = tokens(text)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in t)
        score = sum(math.log10((two[a, b] + kappa * (one[b] + 1) / (n + v + 1)) / ((docs if a is None else one[a]) + kappa))
                    for a, b in zip([None, *t], t))
        result.append((out, len(t), sum(one[x] > 0 for x in t), n, base, score))
    return result
