"""Plain versions of the operators' results, for small tables."""

import collections
import hashlib
import re

import xxhash

from quillgraph.llm.crf import luhn


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def exact(docs):
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[lower(t)].append(i)
    out = collections.Counter()
    for i, t in docs:
        same = groups[lower(t)]
        keep = max((x for x in same if x is not None), default=None)
        out[i, keep, len(same), keep == i] += 1
    return out


def repeated_windows(texts, width):
    """(n_words, n_removed, kept) of each text."""
    words = [[w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode()) if w] for t in texts]
    seen = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def fingerprint(text, shingle=3):
    w = lower(text).encode().split()
    shingles = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [b" ".join(w)] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


def components(values, most):
    """Smallest index reachable from each index over links of at most `most` bits."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def chat(rows):
    """{(conv, turn): (parent, root, n_quoted, n_linked, body)} of messages (conv, turn, role, text), one each."""
    squeezed = lambda t: " ".join(t.lower().split())
    first, quotes, bodies = {}, collections.defaultdict(list), {}
    for conv, turn, _, text in sorted(rows):
        own = []
        for line in text.split("\n"):
            level = len(line) - len(line.lstrip(">"))
            if level:
                quotes[conv, turn].append((level, squeezed(line.lstrip(">"))))
            else:
                own.append(line)
                first.setdefault((conv, squeezed(line)), turn)
        bodies[conv, turn] = "\n".join(own).strip()
    out = {}
    for key, body in bodies.items():
        found = [(level, first[key[0], q]) for level, q in quotes[key] if first.get((key[0], q), key[1]) < key[1]]
        parent = max((-level, turn) for level, turn in found)[1] if found else None
        out[key] = [parent, None, len(quotes[key]), len(found), body]
    for (conv, turn), row in out.items():
        root = turn
        while out[conv, root][0] is not None:
            root = out[conv, root][0]
        row[1] = root
    return {k: tuple(v) for k, v in out.items()}


def base_spans(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), m.end(), 0))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


def sha(x):
    return hashlib.sha256(x).hexdigest()
