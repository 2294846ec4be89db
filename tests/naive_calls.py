"""Naive models of the caller: walks over a contig's whole arrays, one step after another."""

import numpy as np

from helixframe.operators import calls

FLANK = calls.FLANK


def away(x):
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


class Sums:
    def __init__(self, depth, units, ploidy):
        self.cov, self.units, self.ploidy = np.r_[0, np.cumsum(depth)], np.r_[0, np.cumsum(units)], float(ploidy)

    def cn(self, a, b):
        return float(self.ploidy * (self.cov[b] - self.cov[a]) / ((self.units[b] - self.units[a]) / calls.UNIT + calls.EPSILON))


def offset(u, v):
    return sum(abs(away(x) - x) for x in (abs(u - v), u, v))


def scores(depth, units, minsize, ploidy, largest):
    """One place and one scale after another."""
    n = len(depth)
    cov, exp = [0], [0]
    for d, u in zip(depth, units):
        cov.append(cov[-1] + int(d))
        exp.append(exp[-1] + int(u))
    out = np.zeros(n)
    for at in range(n):
        total = 0
        for s in calls.scales(minsize, largest):
            if not s <= at < n - s - 100:
                continue
            l, r = at - s + 1, at + 101
            left, right = (exp[at + 1] - exp[l]) / calls.UNIT, (exp[r + s] - exp[r]) / calls.UNIT
            a = ploidy * (cov[at + 1] - cov[l]) / left if left > 0 else 0.0
            b = ploidy * (cov[r + s] - cov[r]) / right if right > 0 else 0.0
            shift = away(abs(a - b))
            off = abs(abs(a - b) - shift) + abs(a - away(a)) + abs(b - away(b))
            if shift >= 1 and off < 1 - 1e-6:
                total += int(np.floor(shift * (shift - off) * calls.GAIN))
        if total and total / calls.GAIN >= 1.5:
            out[at + 50] = total / calls.GAIN
    return out


def peaks(score):
    """[low, high, pos, height] of the runs; the running maximum is held as a whole number."""
    up, out = score > 0, []
    edge = np.flatnonzero(up[1:] != up[:-1]) + 1
    for k, lo in enumerate(edge):
        if up[lo] and k + 1 < edge.size:
            best, pos = 0, lo
            for i in range(lo, edge[k + 1]):
                if score[i] > best:
                    best, pos = int(score[i]), i
            out.append([int(lo) - 1, int(edge[k + 1]), int(pos), float(score[pos])])
    return out


def climb(s, edge, stop, step, inner, outer, side, best, fixed):
    at = place = edge
    while (at < stop) if step > 0 else (at > stop):
        nxt = at + step
        i, o = ((nxt, inner[1]), (outer[0], nxt)) if side == "left" else ((inner[0], nxt), (nxt, outer[1]))
        if i[1] <= i[0] or o[1] <= o[0]:
            break
        off = offset(s.cn(*i), s.cn(*o))
        if not off < best + 0.1:
            break
        at = nxt
        if off < best and not fixed:
            best, place = off, at
    return place, best, at


def call_contig(pos, depth, units, score, minsize, ploidy=2):
    """A contig's callable bases and their scores -> calls."""
    n = pos.size
    found = peaks(score)
    s = Sums(depth, units, ploidy)
    used, out = [False] * len(found), []
    penalty = [0.0] * len(found)
    for threshold in range(20, calls.FLOOR_SUPPORT - 1, -1):
        last = 0
        for i in range(1, len(found)):
            if found[i][3] < threshold:
                continue
            a, b = found[last], found[i]
            pair, last = (last, i), i
            lo, hi = a[2], b[2]
            if hi - lo < minsize or used[pair[0]] or used[pair[1]]:
                continue
            inner = float(s.cn(lo, hi))
            if away(inner) == ploidy:
                continue
            left, right = (max(0, lo - FLANK), lo), (hi, min(n, hi + FLANK))
            if left[1] <= left[0] or right[1] <= right[0]:
                continue
            sides = [float(s.cn(*left)), float(s.cn(*right))]
            if any(away(x) == away(inner) or abs(x - inner) <= 0.5 for x in sides):
                continue
            used[pair[0]] = used[pair[1]] = True
            # Each boundary is searched towards and away from the other one, then its interval with the offset held.
            for fixed in (False, True):
                for peak, side, order in ((a, "left", (1, -1)), (b, "right", (-1, 1))):
                    for step in order:
                        lo, hi = a[2], b[2]
                        outer = (max(0, lo - FLANK), lo) if side == "left" else (hi, min(n, hi + FLANK))
                        best = float(offset(s.cn(lo, hi), s.cn(*outer)))
                        stop = peak[1] if step > 0 else peak[0]
                        place, best, at = climb(s, peak[2], stop, step, (lo, hi), outer, side, best, fixed)
                        if fixed:
                            peak[1 if step > 0 else 0] = at
                        else:
                            peak[2], penalty[pair[0] if side == "left" else pair[1]] = place, best
            lo, hi = a[2], b[2]
            if hi <= lo or s.units[hi] - s.units[lo] == 0:
                continue
            start, end = int(pos[lo]), int(pos[min(hi, n - 1)])
            share = (hi - lo) / max(end - start, 1)
            if end - start < minsize or share <= 0.1:
                continue
            at = lambda k: int(pos[min(max(k, 0), n - 1)])
            out.append({
                "start": start, "end": end, "cipos_lo": at(a[0]), "cipos_hi": at(a[1]), "ciend_lo": at(b[0]), "ciend_hi": at(b[1]),
                "cn": float(ploidy * (s.cov[hi] - s.cov[lo]) / ((s.units[hi] - s.units[lo]) / calls.UNIT)), "rds": min(a[3], b[3]), "pty": max(penalty[pair[0]], penalty[pair[1]]), "mpb": share,
            })
    return out
