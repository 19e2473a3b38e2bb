"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shards(rows, n=8):
    """rows: (doc_id, text). Result per doc_id order: (doc_id, size, crc, shard, slot)."""
    sized = []
    for d, t in rows:
        b = (t or "").encode()
        sized.append((d, zlib.crc32(b), len(b) + 1))
    sized.sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1], r[2]))
    total, before, slots, out = sum(r[2] for r in sized), 0, Counter(), []
    for d, crc, size in sized:
        s = min(n - 1, (2 * before + size) * n // (2 * total))
        out.append((d, size, crc, s, slots[s]))
        slots[s] += 1
        before += size
    return out


def quality_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def url_rule(url):
    """host, path, rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group(0)
        path = re.match(r"[^?#]*", rest[len(host):]).group(0)
        host = re.sub("[A-Z]", lambda m: m.group(0).lower(), host)
    fits = [r for r in RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h))
            and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def _lower(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


def license_base(text):
    """n_words, n_base, first, last, base_labels."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
    at, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def pii_base(text):
    """Spans (kind, start, end) of the base kinds, in digest order."""
    t, out = text or "", []
    kinds = ("email", "ip", "card", "phone")
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group(0).split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group(0))
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group(0))) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def pii_sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def simhash(text):
    """Fingerprint by the contract, one shingle at a time."""
    import xxhash

    w = SPACE.findall(_lower(text))
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def components(rows, distance=3):
    """rows: (id, fingerprint). Smallest id reachable per row, in the order of the rows."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                root[find(b)] = find(a)
    low = {}
    for d, f in rows:
        r = find(f)
        low[r] = d if r not in low else min(low[r], d)
    return [low[find(f)] for _, f in rows]
