"""The classifiers once more, in plain loops over characters, words and rows."""

import math
from itertools import combinations

import numpy as np

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def lower(text):
    return "".join(c.lower() if ord(c) < 0x600 and len(c.lower()) == 1 else c for c in text)


def bucket(gram, bits, seed):
    h = (len(gram) * 0x9E3779B1 + seed) & M32
    for c in gram:
        h = ((h ^ ord(c)) * 0x01000193) & M32
        h ^= h >> 15
    return ((h * 0x85EBCA6B) & M32) >> (32 - bits)


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


# Toxicity.


def toxic_buckets(text, p):
    t = lower(text or "")
    return {bucket(t[i : i + n], p.bits, p.seed) for n in p.orders for i in range(len(t) - n + 1)}


def toxic_fit(rows, p):
    """rows: (text, label). (weights by bucket, bias)."""
    sets, y = [toxic_buckets(t, p) for t, _ in rows], np.array([label for _, label in rows], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = {}
    for b in set().union(*sets):
        pos, neg = sum(b in s for s, label in zip(sets, y, strict=True) if label), sum(b in s for s, label in zip(sets, y, strict=True) if not label)
        r = math.log((pos + p.smoothing) / (n1 + 2 * p.smoothing)) - math.log((neg + p.smoothing) / (n0 + 2 * p.smoothing))
        if pos + neg >= p.min_docs and abs(r) >= p.min_ratio:
            ratio[b] = r
    names = sorted(ratio)
    x = np.array([[ratio[b] if b in s else 0.0 for b in names] for s in sets])
    w, bias = np.zeros(len(names)), math.log(n1 / n0)
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for k in range(1, p.rounds + 1):
        g = 1 / (1 + np.exp(-np.clip(x @ w + bias, -35, 35))) - y
        gw, gb = x.T @ g / len(y) + p.ridge * w, g.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        step = 0.03 / (1 + k / 40)
        w = w - step * m / (1 - 0.9**k) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        bias -= step * mb / (1 - 0.9**k) / (math.sqrt(vb / (1 - 0.99**k)) + 1e-8)
    return {b: a * ratio[b] for b, a in zip(names, w, strict=True)}, bias


def toxic_score(text, model, p):
    weights, bias = model
    return sigmoid(sum(weights.get(b, 0.0) for b in toxic_buckets(text, p)) + bias)


# Language.


def spaced(text):
    return "".join(lower(c) if c.isalpha() else " " for c in text or "")


def language_fit(rows, p):
    """rows: (text, language). (languages, log-likelihood of (order, bucket, language))."""
    langs = sorted({k for _, k in rows if k is not None})
    counts = {k: [np.zeros(1 << p.bits) for _ in p.orders] for k in langs}
    for text, k in rows:
        if k is not None:
            t = spaced(text)
            for o, n in enumerate(p.orders):
                for i in range(len(t) - n + 1):
                    counts[k][o][bucket(t[i : i + n], p.bits, p.seed)] += 1
    return langs, {k: [np.log(c + p.smoothing) - np.log((c + p.smoothing).sum()) for c in counts[k]] for k in langs}


def language_mixture(text, model, p):
    """Proportions of the chosen set by language, or None without a letter."""
    langs, logp = model
    t = spaced(text)
    words, before = [], " "
    for i, c in enumerate(t):
        if c != " ":
            if before == " ":
                words.append([0.0] * len(langs))
            for o, n in enumerate(p.orders):
                s = i - n // 2
                if s >= 0 and s + n <= len(t):
                    for j, k in enumerate(langs):
                        words[-1][j] += float(np.float32(logp[k][o][bucket(t[s : s + n], p.bits, p.seed)]))
        before = c
    if not words or not langs:
        return None
    like = [[math.exp(max(x - max(w), -p.cap)) for x in w] for w in words]

    def em(allowed):
        pi = [1 / len(allowed) if j in allowed else 0.0 for j in range(len(langs))]
        for _ in range(p.rounds):
            total = [0.0] * len(langs)
            for w in like:
                part = [a * b for a, b in zip(w, pi, strict=True)]
                for j, x in enumerate(part):
                    total[j] += x / max(sum(part), 1e-300)
            pi = [x / len(like) for x in total]
        return pi, sum(math.log(max(sum(a * b for a, b in zip(w, pi, strict=True)), 1e-300)) for w in like)

    every, _ = em(range(len(langs)))
    alone = [sum(math.log(w[j]) for w in like) for j in range(len(langs))]
    rank = list(every)
    rank[max(range(len(langs)), key=lambda j: (alone[j], -j))] = 2
    order = sorted(range(len(langs)), key=lambda j: (-rank[j], j))
    best, top = None, -math.inf
    for size in range(1, len(langs) + 1):
        pi, total = em(order[:size]) if size > 1 else ([float(j == order[0]) for j in range(len(langs))], alone[order[0]])
        value = total - p.penalty * size * math.log(max(2, len(like)))
        if value > top:
            best, top = pi, value
        elif size >= p.least_tries:
            break
    best = [x if x >= p.min_share else 0.0 for x in best]
    return {langs[j]: x / sum(best) for j, x in enumerate(best) if x}


# Quality.


def mix(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & M64
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & M64
    return h ^ h >> 33


def quality_vector(text, p, stats, shares, lengths, bins):
    """{index: value} of a text."""
    data = (text or "").encode()
    white = b" \t\n\x0b\x0c\r"
    kind = lambda c: "space" if c in white else "upper" if 65 <= c <= 90 else "lower" if 97 <= c <= 122 else "high" if c >= 128 else "digit" if 48 <= c <= 57 else "symbol"
    kinds = [kind(c) for c in data]
    words = [w for w in data.replace(b"\x0b", b" ").split()] if data else []
    low = lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w)
    hashed = lambda w: sum((c + 1) * mix(i) for i, c in enumerate(low(w))) & M64
    count = {}
    for w in words:
        k = mix(hashed(w)) >> (64 - p.bits)
        count[k] = count.get(k, 0) + 1
    norm = max(1e-9, math.sqrt(sum(count.values())))
    out = {k: math.sqrt(c) / norm for k, c in count.items()}
    lines = [tuple(map(low, x.replace(b"\x0b", b" ").split())) for x in data.split(b"\n")]
    lines = [x for x in lines if x]
    n, w, letters = max(1, len(data)), max(1, len(words)), sum(k in ("upper", "lower", "high") for k in kinds)
    symbols = lambda x: sum(kind(c) == "symbol" for c in x)
    got = {
        "letters": letters / n, "digits": kinds.count("digit") / n, "symbols": kinds.count("symbol") / n, "capitals": kinds.count("upper") / max(1, letters), "spaces": kinds.count("space") / n,
        "word_length": sum(map(len, words)) / w, "symbol_words": sum(symbols(x) >= 2 for x in words) / w, "line_words": w / max(1, len(lines)), "line_repeats": 1 - len({sum(hashed(x) * 3 + 1 for x in line) & M64 for line in lines}) / max(1, len(lines)),
        "word_repeats": 1 - len(count) / w, "words": len(words), "bytes": len(data), "doubled": sum(a == b and ka == "symbol" for a, b, ka in zip(data, data[1:], kinds, strict=False)) / n,
    }
    for i, name in enumerate(stats):
        edges = lengths if name in ("word_length", "line_words", "words", "bytes") else shares
        out[(1 << p.bits) + i * bins + sum(e < got[name] for e in edges)] = 0.5
    return out


def machine(x, w, v, bias):
    """All pairs, one by one."""
    return bias + sum(w[i] * a for i, a in x.items()) + sum(float(np.dot(v[i], v[j])) * x[i] * x[j] for i, j in combinations(x, 2))
