"""A literal model of the three query modes, row by row."""

import random
from collections import Counter, defaultdict


def random_alignments(seed, n=60, contigs=2, length=200, most=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(length)
        at, cs, muts, last = start, "", [], ""
        while at - start < rng.randint(1, most) or at == start:
            kind = rng.choice(":::*+-")
            if kind == ":" and last != ":":
                k = rng.randint(1, 9)
                cs, at = cs + f":{k}", at + k
            elif kind == "*":
                a, b = rng.choice("acgt"), rng.choice("acgt")
                muts.append(("SUB", at, (b + a).upper()))
                cs, at = cs + f"*{a}{b}", at + 1
            elif kind == "+" and last != "+":
                s = "".join(rng.choice("acgt") for _ in range(rng.randint(1, 3)))
                muts.append(("INS", at, s.upper()))
                cs += f"+{s}"
            elif kind == "-" and last != "-":
                s = "".join(rng.choice("acgt") for _ in range(rng.randint(1, 3)))
                muts.append(("DEL", at, s.upper()))
                cs, at = cs + f"-{s}", at + len(s)
            else:
                continue
            last = kind
        rows.append({"line_no": i, "read_id": f"r{rng.randrange(n)}", "read_length": 500, "contig_id": f"c{rng.randrange(contigs)}", "contig_length": 1000, "read_start": 0, "read_end": 5, "contig_start": start, "contig_end": at, "is_reverse": rng.random() < 0.5, "cs": cs, "muts": muts})
    return rows


def hits(rows, intervals):
    longest = max(r["contig_end"] - r["contig_start"] for r in rows)
    for iv in intervals:
        for r in rows:
            s, e = r["contig_start"], r["contig_end"]
            if r["contig_id"] == iv[1] and s <= iv[3] and (e > iv[2] or (e == iv[2] and e - s < longest)):
                yield iv, r


def text(m):
    return f"{m[2][0]}:{m[2][1]}" if m[0] == "SUB" else ("+" if m[0] == "INS" else "-") + m[2]


def bins(rows, intervals, width):
    out = {}
    for _, c, s, e in intervals:
        if s < e:
            for b in range(s // width * width, e, width):
                out.setdefault((c, b), [0, 0])
    for (_, c, s, e), r in hits(rows, [iv for iv in intervals if iv[2] < iv[3]]):
        for p in range(max(s, r["contig_start"]), min(e, r["contig_end"])):
            out[c, p // width * width][0] += 1
        for m in r["muts"]:
            if s <= m[1] < e:
                out[c, m[1] // width * width][1] += 1
    return sorted((c, b, bp, n) for (c, b), (bp, n) in out.items())


def pileup(rows, intervals, mode):
    pool = {(c, p) for _, c, s, e in intervals for p in range(s, e)}
    cov, var = Counter(), defaultdict(Counter)
    for (_, c, _, _), r in hits(rows, intervals):
        for p in range(r["contig_start"], r["contig_end"]):
            cov[c, p] += 1
        for m in r["muts"]:
            var[c, m[1]][text(m)] += 1
    out = []
    for c, p in sorted(pool):
        n, v = cov[c, p], var[c, p]
        if (mode == "covered" and n == 0) or (mode == "mutated" and not v):
            continue
        rest, total = n - sum(v.values()), 0
        listed = sorted(v.items(), key=lambda x: (-x[1], x[0]))
        if rest > 0 or (mode == "all" and n == 0 and rest == 0):
            listed.append(("REF", rest))
        for name, k in listed:
            total += k
            out.append((c, p + 1, name, k, n, total))
    return out


def heights(rows, style):
    """rows of (contig, start, end, mutations) in order of line; greedy levels."""
    import numpy as np

    order = range(len(rows))
    if style == "by_coord":
        order = sorted(order, key=lambda i: (rows[i][0], rows[i][1], i))
    else:
        order = sorted(order, key=lambda i: (-np.float32(rows[i][3] / max(1, rows[i][2] - rows[i][1])), i))
    levels, out = defaultdict(list), {}
    for i in order:
        c, s, e, _ = rows[i]
        for k, level in enumerate(levels[c]):
            free = all(b <= s for _, b in level) if style == "by_coord" else not any(b >= s and a < e for a, b in level)
            if free:
                break
        else:
            k = len(levels[c])
            levels[c].append([])
        levels[c][k].append((s, e))
        out[i] = k
    return [out[i] for i in range(len(rows))]
