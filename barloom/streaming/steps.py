"""Step functions of the keyed folds: (state, row) -> (state, emitted rows).

Plain functions over one row; the streams that run them are in ``live``. A step may have a function ``ahead``, which is told the
rows that come next and returns the state with what it knows of them; the rows it emits do not depend on it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def price_gate(threshold: float):
    """Emit a price only when it moved by ``threshold`` since the last emitted one."""
    def step(s: dict, r: dict) -> tuple[dict, list[tuple]]:
        p, last = r["price"], s.get("last")
        if last and p > 0 and abs(p - last) / last < threshold:
            return s, []
        return {"last": p}, [(r["t"], r["seq"], p)]
    return step


def ring(size: int):
    """Keep the last ``size`` readings; emit the count and mean after each."""
    def step(s: dict, r: dict) -> tuple[dict, list[tuple]]:
        v = [*s.get("v", []), r["value"]][-size:]
        return {"v": v}, [(r["t"], len(v), float(np.mean(v)))]
    return step


#: Buckets of one size in an ADWIN window before two of them become one of double size.
PER_SIZE = 5


class Window(list):
    """ADWIN buckets [values, sum], oldest first, with their totals and with ``sure``: how many of the ``coming`` values (from ``at``) are known to cut nothing."""

    def __init__(self, buckets: Sequence[Sequence[float]] = ()) -> None:
        super().__init__(list(b) for b in buckets)
        self.n, self.total, self.sure = int(sum(b[0] for b in self)), float(sum(b[1] for b in self)), 0
        self.coming, self.at, self.judged = (), 0, 0

    def add(self, x: float) -> None:
        self.n, self.total, self.at = self.n + 1, self.total + x, self.at + 1
        self.append([1, x])
        end, size = len(self), 1
        while True:
            first = end
            while first and self[first - 1][0] == size:
                first -= 1
            if end - first <= PER_SIZE:
                break
            self[first:first + 2] = [[2 * size, self[first][1] + self[first + 1][1]]]
            # the merged bucket is the newest of the next size
            end, size = first + 1, 2 * size

    def foresee(self, values: Sequence[float], delta: float, at: int = 0) -> None:
        """Sets ``sure`` for ``values``, which come next (from ``at``): up to the first after which a cut might differ beyond the bound.

        All cuts that may stand by then are tried: those between the buckets of now and those between the values. The bound
        (1/c + 1/(n-c)) / 2 * log is taken times ((n-c)/n)^2, and two thousandths less for rounding.
        """
        self.coming, self.at, self.sure = values, at, 0
        if self.n < 10 or at >= len(values):
            return
        sizes, sums = np.array(self).T
        x = np.array(values[at:], dtype=float)
        n, total = self.n + np.arange(1, len(x) + 1), self.total + np.cumsum(x)
        counts, lefts = np.concatenate([np.cumsum(sizes), n]), np.concatenate([np.cumsum(sums), total])
        log = 0.499 * np.log(4.0 * np.log(n) / delta)
        gap = lefts / counts - (total / n)[:, None]
        gap *= gap
        gap -= log[:, None] / counts
        near = ~(gap < (-log / n)[:, None]) & (counts < n[:, None])
        self.sure = int(np.argmax(np.append(near.any(axis=1), True)))


def adwin_update(window: list[list[float]], x: float, delta: float) -> tuple[list[list[float]], bool]:
    """One ADWIN observation on a window of buckets [values, sum], oldest first: cut it where its two parts differ most beyond the bound.

    Bucket sizes are powers of two that fall towards the present, at most PER_SIZE of each, so a window of n values is
    about PER_SIZE * log2(n) buckets, and the cuts tried are those between buckets. A ``Window`` is changed in place; the
    cuts are not tried for a value that it has foreseen to cut nothing.
    """
    w = window if isinstance(window, Window) else Window(window)
    w.add(x)
    if w.sure:
        w.sure -= 1
        return w, False
    if w.n < 10:
        return w, False
    w.judged += 1
    if w.judged % 4 == 0:
        w.foresee(w.coming, delta, w.at)
    sizes, sums = np.array([v[0] for v in w]), np.array([v[1] for v in w])
    n, total = int(sizes.sum()), sums.sum()
    cuts, left = np.cumsum(sizes)[:-1], np.cumsum(sums)[:-1]
    able = (cuts >= 5) & (n - cuts >= 5)
    if not able.any():
        return w, False
    cuts, left, at = cuts[able], left[able], np.flatnonzero(able)
    gap = np.abs(left / cuts - (total - left) / (n - cuts))
    bound = np.sqrt((1.0 / cuts + 1.0 / (n - cuts)) / 2.0 * math.log(4.0 * math.log(n) / delta))
    over = np.where(gap >= bound, gap, 0.0)
    best = int(np.argmax(over))
    if not over[best] > 0:
        return w, False
    rest = Window(w[int(at[best]) + 1:])
    rest.foresee(w.coming, delta, w.at)
    return rest, True


def adwin(delta: float = 0.002):
    def step(s: dict, r: dict) -> tuple[dict, list[tuple]]:
        w, hit = adwin_update(s.get("w", []), r["x"], delta)
        n = sum(v[0] for v in w)
        return {"w": w}, [(r["t"], r["id"], hit, float(sum(v[1] for v in w) / n), int(n))]

    def ahead(s: dict, rows: Sequence[dict]) -> dict:
        w = Window(s.get("w", []))
        w.foresee([r["x"] for r in rows], delta)
        return {"w": w}
    step.ahead = ahead
    return step


def page_hinkley(delta: float = 0.005, limit: float = 50.0, least: int = 30):
    def step(s: dict, r: dict) -> tuple[dict, list[tuple]]:
        n, total = s.get("n", 0) + 1, s.get("sum", 0.0) + r["x"]
        cum = s.get("cum", 0.0) + (r["x"] - total / n - delta)
        low = min(s["low"], cum) if "low" in s else cum
        return {"n": n, "sum": total, "cum": cum, "low": low}, [(r["t"], r["id"], n >= least and cum - low > limit, cum - low)]
    return step


def confirmed_drift(pause: float = 3600.0, span: int = 50):
    """Drift of accuracy together with calibration or feature drift within ``span`` updates, at most once per ``pause`` seconds."""
    names = {"acc": 0.002, "cal": 0.005, "feat": 0.01}

    def step(s: dict, r: dict) -> tuple[dict, list[tuple]]:
        tick, seen = s.get("tick", 0) + 1, dict(s.get("seen", {}))
        nxt = {"tick": tick, "last": s.get("last"), "w": {}}
        for k, d in names.items():
            nxt["w"][k], hit = adwin_update(s.get("w", {}).get(k, []), r[k], d)
            if hit:
                seen[k] = tick
        near = {k: k in seen and tick - seen[k] <= span for k in names}
        fire = near["acc"] and (near["cal"] or near["feat"]) and (nxt["last"] is None or r["t"] - nxt["last"] >= pause)
        if fire:
            nxt["last"], seen = r["t"], {}
        nxt["seen"] = seen
        return nxt, [(r["t"], r["id"], fire)]

    def ahead(s: dict, rows: Sequence[dict]) -> dict:
        held = {k: Window(s.get("w", {}).get(k, [])) for k in names}
        for k, d in names.items():
            held[k].foresee([r[k] for r in rows], d)
        return {**s, "w": held}
    step.ahead = ahead
    return step


def quantile(sorted_values: Sequence[float], q: float) -> float:
    pos = (len(sorted_values) - 1) * q
    lo = math.floor(pos)
    hi = min(lo + 1, len(sorted_values) - 1)
    return sorted_values[lo] + (sorted_values[hi] - sorted_values[lo]) * (pos - lo)


def adaptive_alpha(scores: Sequence[float], target: float = 0.1, gamma: float = 0.005):
    """Coverage feedback: miss more, lower the level; the threshold follows from the calibration scores."""
    ordered = sorted(scores)
    n = len(ordered)

    def threshold(alpha: float) -> float:
        return quantile(ordered, min(1.0, math.ceil((1 - alpha) * (n + 1)) / n))

    def step(s: dict, r: dict) -> tuple[dict, list[tuple]]:
        alpha = s.get("alpha", target)
        miss = (1 - r["prob"] if r["y"] == 1 else r["prob"]) > s.get("q", threshold(target))
        alpha = min(0.5, max(0.001, alpha + gamma * (float(miss) - target)))
        q = threshold(alpha)
        return {"alpha": alpha, "q": q}, [(r["t"], r["id"], not miss, alpha, q)]
    return step


def rolling_monitor(size: int = 100, every: int = 10, least: int = 30, pause: float = 3600.0, low_accuracy: float = 0.5, high_error: float = 0.15):
    """Accuracy and calibration over the last predictions; alerts with a cool-down."""
    def step(s: dict, r: dict) -> tuple[dict, list[tuple]]:
        n = s.get("n", 0) + 1
        seen = [*s.get("seen", []), [r["prob"], r["correct"]]][-size:]
        nxt = {"n": n, "seen": seen, "last": s.get("last")}
        if n % every or len(seen) < least or (nxt["last"] is not None and r["t"] - nxt["last"] < pause):
            return nxt, []
        acc = float(np.mean([c for _, c in seen]))
        ece = 0.0
        for i in range(5):
            cell = [(p, c) for p, c in seen if 0.5 + i * 0.1 <= p < 0.6 + i * 0.1]
            if cell:
                ece += len(cell) / len(seen) * abs(np.mean([p for p, _ in cell]) - np.mean([c for _, c in cell]))
        if acc >= low_accuracy and ece <= high_error:
            return nxt, []
        nxt["last"] = r["t"]
        return nxt, [(r["t"], r["id"], acc, float(ece))]
    return step


def loss_streak(limit: int = 3, factor: float = 0.5, floor: float = 0.25):
    """Daily result, losses in a row (kept across days) and the size factor they imply."""
    def step(s: dict, r: dict) -> tuple[dict, list[tuple]]:
        day = int(r["t"] // 86400)
        daily = r["pnl"] + (s.get("daily", 0.0) if s.get("day") == day else 0.0)
        losses = 0 if r["pnl"] >= 0 else s.get("losses", 0) + 1
        size = max(floor, factor ** (losses - limit + 1)) if losses >= limit else 1.0
        return {"day": day, "daily": daily, "losses": losses}, [(r["t"], r["id"], daily, losses, size)]
    return step


def pick_lifecycle(hold: float = 43200.0, life: float = 86400.0):
    """Picks of a symbol against its prices: suppress repeats, step the status, expire after a day.

    Rows carry kind 'pick' (with direction and levels) or 'price'. A stop only closes a pick
    that has reached no target yet; targets move the status up and never down.
    """
    rank = {"PENDING": 0, "TP1": 1, "TP2": 2, "TP3": 3}

    def step(s: dict, r: dict) -> tuple[dict, list[tuple]]:
        out: list[tuple] = []
        alive = []
        for p in s.get("open", []):
            if r["t"] - p["t"] > life:
                out.append((p["id"], r["t"], "EXPIRED" if p["status"] == "PENDING" else p["status"], p["best"], p["worst"], True))
            else:
                alive.append(p)
        taken = s.get("taken")
        if r["kind"] == "pick":
            if taken is None or r["t"] - taken >= hold:
                taken = r["t"]
                alive.append({"id": r["id"], "t": r["t"], "up": r["direction"] == "BULLISH", "tp": [r["tp1"], r["tp2"], r["tp3"]], "sl": r["sl"], "status": "PENDING", "best": r["price"], "worst": r["price"]})
                out.append((r["id"], r["t"], "PENDING", r["price"], r["price"], False))
            return {"open": alive, "taken": taken}, out
        price, kept = r["price"], []
        for p in alive:
            sign = 1 if p["up"] else -1
            p["best"], p["worst"] = (max(p["best"], price), min(p["worst"], price)) if p["up"] else (min(p["best"], price), max(p["worst"], price))
            reached = sum(sign * price >= sign * x for x in p["tp"])
            if p["status"] == "PENDING" and sign * price <= sign * p["sl"]:
                out.append((p["id"], r["t"], "SL", p["best"], p["worst"], True))
                continue
            if reached > rank[p["status"]]:
                p["status"] = f"TP{reached}"
                out.append((p["id"], r["t"], p["status"], p["best"], p["worst"], reached == 3))
            if p["status"] != "TP3":
                kept.append(p)
        return {"open": kept, "taken": taken}, out
    return step


def quiet_picks(life: float = 86400.0):
    """What a timer does for the picks of a symbol without rows: when the next one ends, and those that have ended by ``now``."""
    def expire(s: dict, now: float) -> tuple[dict, list[tuple]]:
        over = [p for p in s.get("open", []) if now - p["t"] > life]
        out = [(p["id"], int(p["t"] + life), "EXPIRED" if p["status"] == "PENDING" else p["status"], p["best"], p["worst"], True) for p in over]
        return {**s, "open": [p for p in s.get("open", []) if now - p["t"] <= life]}, out
    return lambda s: min(p["t"] for p in s["open"]) + life if s.get("open") else None, expire


def quiet_decisions(life: float = 30 * 86400.0):
    """The same for decisions that wait for a target or a stop."""
    def expire(s: dict, now: float) -> tuple[dict, list[tuple]]:
        hits = s.get("hits", [])
        out = [(d[0], int(d[4] + life), "EXPIRED", float(np.mean(hits)) if hits else None) for d in s.get("open", []) if now - d[4] > life]
        return {**s, "open": [d for d in s.get("open", []) if now - d[4] <= life]}, out
    return lambda s: min(d[4] for d in s["open"]) + life if s.get("open") else None, expire


def daily_cap(limit: int = 20):
    """The first ``limit`` picks of a day pass."""
    def step(s: dict, r: dict) -> tuple[dict, list[tuple]]:
        n = s.get("n", 0)
        return ({"n": n + 1}, [(r["t"], r["id"])]) if n < limit else (s, [])
    return step


def decision_outcome(life: float = 30 * 86400.0):
    """Vetoed decisions of a symbol: did the price then run to the target or to the stop.

    A decision that neither reached within ``life`` seconds is given out as expired, so the state does not grow without end.
    """
    def step(s: dict, r: dict) -> tuple[dict, list[tuple]]:
        waiting, hits = s.get("open", []), s.get("hits", [])
        if r["kind"] == "pick":
            return {"open": [*waiting, [r["id"], r["direction"] == "BULLISH", r["tp1"], r["sl"], r["t"]]], "hits": hits}, []
        out, left = [], []
        for pid, up, tp, sl, at in waiting:
            sign = 1 if up else -1
            if r["t"] - at > life:
                out.append((pid, r["t"], "EXPIRED", float(np.mean(hits)) if hits else None))
            elif sign * r["price"] >= sign * tp or sign * r["price"] <= sign * sl:
                saved = not sign * r["price"] >= sign * tp
                hits = [*hits, float(saved)][-100:]
                out.append((pid, r["t"], "SAVED FROM LOSS" if saved else "MISSED PROFIT", float(np.mean(hits))))
            else:
                left.append([pid, up, tp, sl, at])
        return {"open": left, "hits": hits}, out
    return step


def breakout(p: dict, lookback: int = 20, cooldown: int = 48, period: int = 14, keep: int = 80):
    """Tiered breakout detector on closed bars with a bounded buffer and an incremental Wilder ATR.

    The ATR is seeded as in batch: the mean of the true ranges of bars 1..period.
    """
    def setup(b: list[list[float]], i: int) -> dict | None:
        if i < lookback:
            return None
        o, h, lo, c, v = b[i]
        prior = b[i - lookback: i]
        avg_body, avg_vol = float(np.mean([abs(x[3] - x[0]) for x in prior])), float(np.mean([x[4] for x in b[i - 20: i]]))
        body, span, base = c - o, h - lo, max(o, 1e-12)
        if body <= 0 or body / base < 0.01 or span <= 0 or avg_body <= 0 or avg_vol <= 0:
            return None
        m = {"eff": body / span, "ratio": body / avg_body, "quiet": avg_body / base * 100, "vol": v / avg_vol, "close": c, "high": h, "mid": 0.5 * (o + c)}
        if m["eff"] < p["body_eff"] or m["ratio"] < p["body_ratio"] or m["quiet"] >= p["quiet_pct"] or m["vol"] < p["vol"]:
            return None
        m["now"] = m["eff"] >= p["now_body_eff"] and m["ratio"] >= p["now_body_ratio"] and m["vol"] >= p["now_vol"]
        return m

    def step(s: dict, r: dict) -> tuple[dict, list[tuple]]:
        b, n = s.get("b", []), s.get("n", 0)
        bar = [r["open"], r["high"], r["low"], r["close"], r["volume"]]
        prev = b[-1][3] if b else None
        tr = bar[1] - bar[2] if prev is None else max(bar[1] - bar[2], abs(bar[1] - prev), abs(bar[2] - prev))
        seed, atr = s.get("seed", 0.0), s.get("atr", 0.0)
        if 1 <= n <= period:
            seed += tr
            atr = seed / period if n == period else 0.0
        elif n > period:
            atr = (atr * (period - 1) + tr) / period
        b = [*b, bar][-keep:]
        nxt = {"b": b, "n": n + 1, "seed": seed, "atr": atr, "last": s.get("last")}
        i = len(b) - 1
        if n <= lookback or (nxt["last"] is not None and n - nxt["last"] < cooldown):
            return nxt, []
        now, one, two = setup(b, i), setup(b, i - 1), setup(b, i - 2)
        tier = None
        if now and now["now"]:
            tier = "A"
        elif one and bar[2] >= one["mid"] and bar[3] >= one["close"] and bar[1] >= one["high"]:
            tier = "B"
        elif two and b[i - 1][2] >= two["mid"] and bar[3] >= two["close"] and bar[1] >= two["high"]:
            vol = float(np.mean([x[4] for x in b[i - 20: i]]))
            tier = "C" if vol > 0 and bar[4] / vol >= p["cont_vol"] else None
        if tier is None:
            return nxt, []
        nxt["last"] = n
        return nxt, [(r["t"], n, tier, bar[3], atr)]
    return step
