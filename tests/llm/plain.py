"""The text operators once more, row by row in plain Python, for tests on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import xxhash

MASK = (1 << 64) - 1


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def xx(*values, seed=42):
    """Spark's hash of several columns; a null leaves the state as it is.  An int is (value, bytes)."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True), seed)
    return seed


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def shingles(text):
    w = words(fold(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def fingerprint(text, bins=256):
    draw = random.Random(bins)
    starts, steps = [draw.randrange(bins) for _ in range(bins)], [draw.randrange(1, bins, 2) for _ in range(bins)]
    s = shingles(text)
    if not s:
        return "00" * bins
    least = {}
    for g in s:
        # A text of fewer words than a shingle is hashed as one string.
        h = signed(xx(*g) if len(words(text)) >= 5 else xx(" ".join(g)))
        at = (h >> 56) + bins // 2
        least[at] = min(h, least.get(at, h))
    out = []
    for i in range(bins):
        t = 0
        at = i
        while at not in least:
            t += 1
            at = (starts[i] + t * steps[i]) % bins
        out.append(f"{least[at] & 255:02x}")
    return "".join(out)


def likeness(a, b):
    none = "0" * len(a)
    if a == b:
        return 1.0
    if none in (a, b):
        return 0.0
    share = sum(a[k : k + 2] == b[k : k + 2] for k in range(0, len(a), 2)) / (len(a) // 2)
    return min(1.0, max(0.0, (share - 1 / 256) / (1 - 1 / 256)))


def components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def mix64(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


BASE = 0x9E3779B97F4A7C15 | 1


def word_hash(data):
    lanes = [int.from_bytes(data[i : i + 8], "little") for i in range(0, max(len(data), 1), 8)]
    total = sum(mix64((lane + mix64((i * BASE + BASE) & MASK)) & MASK) for i, lane in enumerate(lanes))
    return mix64((total + len(data) * 0xD6E8FEB86659FD93) & MASK)


def buckets(text):
    hashed = [w.encode() for w in words(fold(text))]
    one = [word_hash(w) for w in hashed]
    pairs = [mix64(((a * BASE + b) * BASE) & MASK) for a, b in zip(one, one[1:])]
    return [h >> 48 for h in one] + [h >> 48 for h in pairs] + [(word_hash(w[:4]) >> 48) + 65536 for w in hashed]


def log_ratios(texts, good):
    raw, target = Counter(), Counter()
    for t, g in zip(texts, good, strict=True):
        b = buckets(t)
        raw.update(b)
        if g:
            target.update(b)
    out = {}
    for part in (0, 1):
        r = {b: n for b, n in raw.items() if b // 65536 == part}
        scale = sum(target[b] for b in r) / max(1, sum(r.values()))
        own = {b: math.log((target[b] + 3) / (n * scale + 3)) for b, n in r.items()}
        usual = [b for b, v in own.items() if v >= -0.5]
        pooled = math.log(sum(target[b] for b in usual) / sum(r[b] * scale for b in usual))
        out |= {b: pooled if v >= -0.5 else v for b, v in own.items()}
    return out


def gumbel(seed, key, text):
    u = ((xx((seed, 4), (key, 8) if key is not None else None, text) >> 11) + 0.5) / (1 << 53)
    return -math.log(-math.log(u))


def kept_by_importance(rows, ratios, scale, seed=11):
    """Indices of (id, text) that stay."""
    b, a = scale
    weight = [b + a * math.asinh(sum(ratios.get(x, 0.0) for x in buckets(t))) for _, t in rows]
    k = round(sum(1 / (1 + math.exp(-w)) for w in weight))
    keys = [w + gumbel(seed, i, t) for w, (i, t) in zip(weight, rows, strict=True)]
    cut = sorted(keys, reverse=True)[k - 1] if 0 < k < len(keys) else (-math.inf if k else math.inf)
    return [n for n, x in enumerate(keys) if x >= cut]


def mixed(rows, entropy=0.9, most_passes=2.0, budget=None, seed=3, rows_per_block=2000):
    """(id, text, source) to Counter of (id, text, source, tokens, pass, block)."""
    own = [-(-len((t or "").encode()) // 4) for _, t, _ in rows]
    tokens, count = defaultdict(int), Counter()
    for (_, _, s), n in zip(rows, own, strict=True):
        tokens[s] += n
        count[s] += 1
    live = {s: n for s, n in tokens.items() if n}
    total = sum(live.values())

    def figures(a):
        power = {s: (n / total) ** a for s, n in live.items()}
        z = sum(power.values())
        held = budget or total * z * max((n / total) ** (1 - a) for n in live.values())
        return z, -sum(p / z * math.log(p / z) for p in power.values()), max(p / z * held / live[s] for s, p in power.items()), held

    def halve(right, low, high):
        for _ in range(20):
            mid = (low + high) / 2
            low, high = (low, mid) if right(mid) else (mid, high)
        return low, high

    a = 1.0
    if live:
        goal = (entropy or 0) * math.log(len(live))
        if entropy is not None and figures(1.0)[1] < goal:
            a = halve(lambda x: figures(x)[1] < goal, 0.0, 1.0)[0]
        if a < 1.0 and figures(a)[2] > most_passes:
            a = halve(lambda x: figures(x)[2] <= most_passes, a, 1.0)[1]
        z, _, _, held = figures(a)
    place = lambda n, i, t: xx((seed, 4), (n, 8), (i, 8) if i is not None else None, t) >> 11
    out = Counter()
    for s in tokens:
        here = [(i, t, n) for (i, t, x), n in zip(rows, own, strict=True) if x == s]
        quota = round((tokens[s] / total) ** a / z * held) if tokens[s] else 0
        quota = max(quota, tokens[s]) if budget is None else quota
        whole, rest = divmod(quota, tokens[s]) if tokens[s] else (0, 0)
        last, used = set(), 0
        for p in sorted({place(whole, i, t) for i, t, _ in here}):
            used += sum(n for i, t, n in here if place(whole, i, t) == p)
            if used > rest:
                break
            last.add(p)
        blocks = -(-count[s] // rows_per_block)
        for i, t, n in here:
            for k in range(whole + (place(whole, i, t) in last) if n else 1):
                out[i, t, s, n, k, int(place(k, i, t) / 2**53 * blocks)] += 1
    return out


# Pseudonyms


def draw(key, tag, half, modulus):
    return int(hashlib.sha256(f"{key}:{tag}:{half}".encode()).hexdigest()[:15], 16) % modulus


def network(a, b, m, n, key, tag):
    for r in range(6):
        if r % 2 == 0:
            a = (a + draw(key, tag + "a", f"{r}{b}", m)) % m
        else:
            b = (b + draw(key, tag + "b", f"{r}{a}", n)) % n
    return a, b


def digits_of(v):
    return re.sub("[^0-9]", "", v)


def permuted(d, key, tag):
    h = len(d) // 2
    a, b = network(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), key, tag)
    return str(a).zfill(h) + str(b).zfill(len(d) - h)


def refill(v, d):
    it = iter(d)
    return "".join(next(it) if c in "0123456789" else c for c in v)


def luhn(body):
    """The check digit that completes some digits."""
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
    return (10 - total % 10) % 10


def letters(v, key, tag):
    alphabets = ["0123456789abcdef"] if tag == "secret" else ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"]

    def moved(part, by, r):
        g, out = hashlib.sha256(f"{key}:{tag}{r}:{by}".encode()).hexdigest(), ""
        for i, c in enumerate(part):
            x = next((x for x in alphabets if c in x), None)
            at = 3 * i % 60
            out += x[(x.index(c) + int(g[at : at + 3], 16)) % len(x)] if x else c
        return out

    a, b = v[: len(v) // 2], v[len(v) // 2 :]
    for r in range(6):
        a, b = (moved(a, f"{r}{b}", 0), b) if r % 2 == 0 else (a, moved(b, f"{r}{a}", 1))
    return a + b


def pseudonym(v, key, kinds):
    whole = lambda k: re.fullmatch(kinds[k], v)
    d = digits_of(v)
    if "@" in v:
        name, _, host = v.partition("@")
        return letters(name, key, "mail") + "@" + host
    if whole("date"):
        layout = "%Y-%m-%d" if "-" in v else "%m/%d/%Y" if "/" in v else "%d.%m.%Y"
        try:
            n = (datetime.strptime(v, layout).date() - date(1800, 1, 1)).days
        except ValueError:
            return v
        if not 0 <= n < 189 * 773:
            return v
        a, b = network(n // 773, n % 773, 189, 773, key, "date")
        fresh = date(1800, 1, 1) + timedelta(a * 773 + b)
        return layout.replace("%Y", f"{fresh.year:04d}").replace("%m", f"{fresh.month:02d}").replace("%d", f"{fresh.day:02d}")
    if whole("ip"):
        p = [int(x) for x in v.split(".")]
        if max(p) > 255:
            return v
        a, b = network(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if whole("ssn"):
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        areas = [x for x in range(1, 900) if x != 666]
        if area not in areas or not group or not serial:
            return v
        a, b = network(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
        return refill(v, f"{areas[a // 99]:03d}{a % 99 + 1:02d}{b + 1:04d}")
    if whole("phone"):
        if re.fullmatch("1?[2-9][0-9]{2}[2-9][0-9]{6}", d):
            a, b = network(int(d[-10:-7]) - 200, int(d[-7:]) - 2000000, 800, 8000000, key, "phone")
            return refill(v, d[:-10] + f"{a + 200:03d}{b + 2000000:07d}")
        return refill(v, permuted(d, key, "phone")) if v[0] == "+" and 7 <= len(d) <= 15 else v
    if v.startswith("AKIA"):
        return "AKIA" + letters(v[4:], key, "key")
    if re.search("[a-f]", v) or len(v) > 36:
        return letters(v, key, "secret")
    if 13 <= len(d) <= 19 and luhn(d[:-1]) == int(d[-1]):
        body = permuted(d[:-1], key, "card")
        return refill(v, body + str(luhn(body)))
    return refill(v, permuted(d, key, "number")) if 13 <= len(d) <= 36 else v


def pseudonymised(text, key, pattern, kinds):
    """``pattern`` and ``kinds`` are the operator's own expressions, which are its definition of what is private."""
    return text if text is None else re.sub(pattern, lambda m: pseudonym(m[0], key, kinds), text, flags=re.ASCII)


def float32(ratios):
    return {b: float(np.float32(v)) for b, v in ratios.items()}
