"""Plain versions of operators, row by row and without Spark."""

import math
import re
from collections import Counter


def words_of(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def katz(texts, learn, order, discounts, k=5):
    """(n_tokens, n_known, train_tokens, base_score, score) of each text, from counts kept as they are; checks that contexts sum to one."""
    end, start = "</s>", "<s>"
    tokens = [[*words_of(t, lower=True), end] for t in texts]
    padded = [[start] * (order - 1) + t for t in tokens]
    counts = [Counter() for _ in range(order + 1)]
    for t, taken in zip(padded, learn, strict=True):
        for i in range(order - 1, len(t) if taken else 0):
            for n in range(1, order + 1):
                counts[n][tuple(t[i - n + 1 : i + 1])] += 1
    total = sum(counts[1].values())
    below = total + 0.5 * (len(counts[1]) + 1)
    cut = {n: discounts([0] + [sum(c == r for c in counts[n].values()) for r in range(1, k + 2)]) for n in range(2, order + 1)}
    follow, known = {}, {}
    for n in range(2, order + 1):
        for g in counts[n]:
            follow.setdefault(g[:-1], []).append(g[-1])

    def worth(r, n):
        return cut[n][r] if r <= k else r

    def context(h):
        if h not in known:
            n = len(h) + 1
            c, kept = sum(counts[n][(*h, w)] for w in follow[h]), sum(worth(counts[n][(*h, w)], n) for w in follow[h])
            room = c if kept < c else c + 0.5
            known[h] = room, (1 - kept / room) / (1 - sum(p(w, h[1:]) for w in follow[h]))
        return known[h]

    def p(w, h):
        if not h:
            return (counts[1][(w,)] + 0.5) / below
        if h not in follow:
            return p(w, h[1:])
        room, left = context(h)
        r = counts[len(h) + 1][(*h, w)]
        return worth(r, len(h) + 1) / room if r else left * p(w, h[1:])

    for h in list(follow)[:: max(1, len(follow) // 40)]:
        assert abs(sum(p(w, h) for (w,) in counts[1]) + p("a word never seen", h) - 1) < 1e-9
    out = []
    for t, full in zip(tokens, padded, strict=True):
        score = sum(math.log10(p(full[i], tuple(full[i - order + 1 : i]))) for i in range(order - 1, len(full)))
        out.append((len(t), sum((w,) in counts[1] for w in t), total, sum(math.log10(p(w, ())) for w in t), score))
    return out
