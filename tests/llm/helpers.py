"""Brute-force versions, in plain Python, of what the operators' queries return."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

BLANK_WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    out = []
    for t in data:
        mask = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                mask[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(t)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.append((len(t), sum(mask), runs, sha(bytes(b for b, m in zip(t, mask) if not m))))
    return out


def shingles(text, size=4):
    w = BLANK_WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(docs, size=4):
    """docs: [(doc_id, text)] with distinct ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in index[g]).items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            index[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contamination(texts, items):
    word = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: word.findall((t or "").translate(LOWER))
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for item, x in items:
            b = words(x)
            m = min(13, len(b))
            wins = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else set()
            for i in range(len(w) - m + 1 if m else 0):
                if tuple(w[i : i + m]) in wins:
                    hit |= set(range(i, i + m))
                    ids.add(str(item))
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(ids))), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return out


def rule_counts(text):
    w = BLANK_WORD.findall(text or "")
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, inside = Counter(g), set()
    for i, x in enumerate(g):
        if n[x] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if BLANK_WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def secret_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text or "") if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m.group()) >= 24]
    out.sort()
    return [sum(k == n for _, k, _ in out) for n in range(3)], sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in out))


def luhn(d):
    x = [int(c) for c in d][::-1]
    return sum(v if i % 2 == 0 else (2 * v - 9 if 2 * v > 9 else 2 * v) for i, v in enumerate(x)) % 10 == 0


def pii_spans(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return [sum(k == n for k, _, _ in out) for n in range(4)], sha(",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in out))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
