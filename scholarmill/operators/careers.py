"""Fits to the careers of authors and the citations of publications, one small series a group."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from scholarmill.schema import MetricError
from scholarmill.session import spread

#: Numbers in a batch of series that are fitted together; a longer series is a batch of its own.
FIT_CELLS = 200_000


def _best_step(y: np.ndarray) -> tuple[float, int, int]:
    """(squared error, i, j) of the best step y[i:j] on a level of its own, 1 <= i < j <= n - 1; the first of equals."""
    n = len(y)
    s, q = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y * y)])
    i, j = np.triu_indices(n - 1, k=1)
    i, j = i + 1, j + 1
    inside, outside = j - i, n - (j - i)
    a = s[j] - s[i]
    sse = (q[j] - q[i]) - a * a / inside + (q[n] - (q[j] - q[i])) - (s[n] - a) ** 2 / outside
    k = int(np.argmin(np.round(sse, 12))) if len(sse) else -1
    return (max(0.0, float(sse[k])), int(i[k]), int(j[k])) if k >= 0 else (math.inf, 0, 0)


def _streak(citations: np.ndarray, penalty: float) -> tuple[float, float | None, int | None, int | None]:
    """(baseline, streak level, first and last position of the streak) of a career in its order."""
    n = len(citations)
    width = max(5, int(0.1 * n))
    log = np.log10(citations)
    if n < width + 3:
        return float(log.mean()), None, None, None
    y = np.convolve(log, np.ones(width) / width, "valid")
    half = width // 2
    flat = math.sqrt(float(((y - y.mean()) ** 2).sum())) + penalty
    sse, i, j = _best_step(y)
    if math.sqrt(sse) + 3 * penalty >= flat:
        return float(y.mean()), None, None, None
    outside = np.concatenate([y[:i], y[j:]])
    return float(outside.mean()), float(y[i:j].mean()), i + half, j - 1 + half


def hot_streak(df: DataFrame, by: str = "AuthorId", column: str = "C10", date: str = "Date", tie: str = "PublicationId", streaks: int = 1, penalty: float = 1.0) -> DataFrame:
    """(by, Baseline, StreakGamma, StreakStart, StreakEnd): a period of higher impact in each career, its dates null if there is none.

    Impact is the centred moving mean of log10 citations over max(5, a tenth
    of the career) publications. A level of its own for one period costs two
    penalties more than one level. Rows without positive citations are left
    out. Up to two streaks, one a row: the second is sought in the longer
    side of the career without the first.
    """
    if streaks not in (1, 2):
        raise MetricError(f"{streaks} streaks")
    rows = df.select(by, F.col(date).cast("string").alias("_d"), F.col(tie).alias("_t"), F.col(column).cast("double").alias("_c")).dropna().where("_c > 0")
    kind = dict(df.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_d", "_t"])
        dates, c = pdf["_d"].tolist(), pdf["_c"].to_numpy()
        base, level, i, j = _streak(c, penalty)
        out = [(base, level, None if i is None else dates[i], None if j is None else dates[j])]
        if streaks == 2 and i is not None:
            lo, hi = (0, i) if i >= len(c) - 1 - j else (j + 1, len(c))
            if hi - lo:
                b2, l2, i2, j2 = _streak(c[lo:hi], penalty)
                if i2 is not None:
                    out.append((b2, l2, dates[lo + i2], dates[lo + j2]))
        out = pd.DataFrame(out, columns=["Baseline", "StreakGamma", "StreakStart", "StreakEnd"])
        out.insert(0, by, pdf[by].iloc[0])
        return out

    return rows.groupBy(by).applyInPandas(run, f"{by} {kind}, Baseline double, StreakGamma double, StreakStart string, StreakEnd string")


def _two_lines(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """(break, value there, slopes before and after) of the continuous two-part line with least squares; for a fixed break it is a linear problem."""

    def solve(t: float) -> tuple[float, np.ndarray]:
        a = np.stack([np.ones(len(x)), np.minimum(x - t, 0), np.maximum(x - t, 0)], 1)
        w = np.linalg.lstsq(a, y, rcond=None)[0]
        return float(((a @ w - y) ** 2).sum()), w

    lo, hi = float(x.min()), float(x.max())
    grid = np.linspace(lo, hi, 41)[1:-1]
    t = min(grid, key=lambda v: solve(v)[0])
    step = (hi - lo) / 40
    for _ in range(30):
        t = min((t - step, t, t + step), key=lambda v: solve(min(max(v, lo), hi))[0])
        t = min(max(t, lo), hi)
        step /= 2
    w = solve(t)[1]
    return t, float(w[0]), float(w[1]), float(w[2])


def productivity_trajectory(yearly: DataFrame, by: str = "AuthorId", date: str = "Year", column: str = "YearlyProductivity") -> DataFrame:
    """(by, t_break, b, m1, m2): the continuous line of two parts that fits a career's yearly productivity best; nulls with fewer than four years."""
    rows = yearly.select(by, F.col(date).cast("double").alias("_x"), F.col(column).cast("double").alias("_y")).dropna()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_x", "_y"])
        fit = _two_lines(pdf["_x"].to_numpy(), pdf["_y"].to_numpy()) if pdf["_x"].nunique() >= 4 else (None,) * 4
        return pd.DataFrame([(pdf[by].iloc[0], *fit)], columns=[by, "t_break", "b", "m1", "m2"]).astype({c: float for c in ("t_break", "b", "m1", "m2")})

    return rows.groupBy(by).applyInPandas(run, f"{by} {dict(yearly.dtypes)[by]}, t_break double, b double, m1 double, m2 double")


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function to 1.2e-7, by a rational Chebyshev fit; math.erf takes one number at a time."""
    t = 1 / (1 + 0.5 * np.abs(x))
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    power = np.zeros_like(t)
    for c in reversed(fit):
        power = power * t + c
    tail = t * np.exp(-x * x + power)
    return np.where(x >= 0, 1 - tail, tail - 1)


def predicted_citations(t: np.ndarray, lam: float, mu: float, sig: float, m: float = 30.0) -> np.ndarray:
    """m (exp(lam Phi((ln t - mu) / sig)) - 1): citations t after publication."""
    return m * (np.exp(lam * 0.5 * (1 + _erf((np.log(t) - mu) / sig / math.sqrt(2)))) - 1)


def _fit_many(series: list[np.ndarray]) -> np.ndarray:
    """Levenberg-Marquardt from (1, 1, 1), with numeric derivatives, for many series at once: a row (lam, mu, sig) for each."""
    n = [len(t) for t in series]
    inside = np.arange(max(n)) < np.array(n)[:, None]
    times = np.ones(inside.shape)
    times[inside] = np.concatenate(series)
    count = np.arange(1, max(n) + 1, dtype=float)
    p, damp, left = np.ones((len(n), 3)), [1e-2] * len(n), list(range(len(n)))

    def error(p: np.ndarray, rows: list[int]) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.nan_to_num(predicted_citations(times[rows], *p.T[:, :, None]) - count, nan=1e9, posinf=1e9, neginf=-1e9)

    r = error(p, left)
    for _ in range(80):
        if not left:
            break
        now = p[left]
        jac = np.stack([(error(now + h, left) - r) / h[k] for k, h in enumerate(np.eye(3) * 1e-6)], 2)
        step = np.empty((len(left), 3))
        # Sums are over each series by itself, as rounding decides where a flat fit stops.
        for k, i in enumerate(left):
            j = jac[k, : n[i]]
            a = j.T @ j
            step[k] = np.linalg.lstsq(a + damp[i] * np.diag(np.diag(a) + 1e-12), -j.T @ r[k, : n[i]], rcond=None)[0]
        new = now + step
        new[:, 2] = np.maximum(np.abs(new[:, 2]), 1e-3)
        r2, size, go = error(new, left), np.abs(step).max(1), []
        for k, i in enumerate(left):
            x, y = r[k, : n[i]], r2[k, : n[i]]
            was, is_ = x @ x, y @ y
            if is_ < was:
                p[i], r[k], damp[i] = new[k], r2[k], damp[i] / 3
                if size[k] >= 1e-9 and was - is_ >= 1e-9 * was:
                    go.append(k)
            else:
                damp[i] *= 4
                if damp[i] <= 1e12:
                    go.append(k)
        left, r = [left[k] for k in go], r[go]
    return p


def _fit_longterm(t: np.ndarray) -> tuple[float, float, float]:
    """The fit of one series."""
    return tuple(map(float, _fit_many([t])[0]))


def longterm_impact(refs: DataFrame, by: str = "CitedPublicationId", date: str = "CitingYear") -> DataFrame:
    """(by, lam, mu, sig) of the log-normal citation model, fitted to the times since the first citation; nulls with fewer than three later ones. Dates count in days."""
    kind = dict(refs.dtypes)[date]
    when = F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) if kind in ("date", "timestamp") else F.col(date)
    rows = spread(refs.select(by, when.cast("double").alias("_t")).dropna(), by)
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    lists = lists.select(by, F.filter(F.transform("_ts", lambda t: t - F.col("_ts")[0]), lambda t: t > 0).alias("_ts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.iloc[np.argsort(pdf["_ts"].map(len).to_numpy(), kind="stable")]
            begin, series = 0, pdf["_ts"].tolist()
            while begin < len(series):
                end = begin + 1
                while end < len(series) and len(series[end]) * (end + 1 - begin) <= FIT_CELLS:
                    end += 1
                yield pd.DataFrame({"_ts": series[begin:end]} | dict(zip(("lam", "mu", "sig"), _fit_many(series[begin:end]).T)))
                begin = end

    # Equal series have one fit.
    fits = spread(lists.where(F.size("_ts") >= 3).select("_ts"), "_ts").distinct().mapInPandas(run, "_ts array<double>, lam double, mu double, sig double")
    return lists.join(fits, "_ts", "left").select(by, *(F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in ("lam", "mu", "sig")))


def louvain(ids: list, edges: list[tuple[int, int, float]], resolution: float = 1.0) -> list[int]:
    """Communities by greedy modularity in a fixed order, numbered from 0 by their first vertex."""
    n = len(ids)
    label = list(range(n))
    near = [dict() for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    groups, loops = [[i] for i in range(n)], [0.0] * n
    while True:
        degree = [sum(x.values()) + s for x, s in zip(near, loops)]
        total = sum(degree) or 1
        own, load = list(range(len(near))), list(degree)
        moved, any_move = True, False
        while moved:
            moved = False
            for v in range(len(near)):
                links: dict[int, float] = {}
                for u, w in near[v].items():
                    links[own[u]] = links.get(own[u], 0) + w
                load[own[v]] -= degree[v]
                best, gain = own[v], links.get(own[v], 0) - resolution * load[own[v]] * degree[v] / total
                for c in sorted(links):
                    g = links[c] - resolution * load[c] * degree[v] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                if best != own[v]:
                    own[v], moved, any_move = best, True, True
                load[own[v]] += degree[v]
        if not any_move:
            break
        names = {c: i for i, c in enumerate(dict.fromkeys(own))}
        fresh: list[dict[int, float]] = [dict() for _ in names]
        new_loops, new_groups = [0.0] * len(names), [[] for _ in names]
        for v, c in enumerate(own):
            new_groups[names[c]] += groups[v]
            new_loops[names[c]] += loops[v]
            for u, w in near[v].items():
                if own[u] == c:
                    new_loops[names[c]] += w
                else:
                    fresh[names[c]][names[own[u]]] = fresh[names[c]].get(names[own[u]], 0) + w
        near, loops, groups = fresh, new_loops, new_groups
    for k, members in enumerate(groups):
        for v in members:
            label[v] = k
    names = {c: i for i, c in enumerate(dict.fromkeys(label))}
    return [names[c] for c in label]


def career_topics(paa: DataFrame, pub2ref: DataFrame, year: str = "Year") -> DataFrame:
    """(AuthorId, PublicationId, Year, TopicCommunity, Degree): communities in the network of common references of each career.

    Only the largest connected part of a career counts, that with the least id
    of equal ones; links are unweighted.
    """
    mine = paa.select("AuthorId", "PublicationId", year).dropna().dropDuplicates(["AuthorId", "PublicationId"])
    refs = mine.join(pub2ref.select(F.col("CitingPublicationId").alias("PublicationId"), "CitedPublicationId").dropna().distinct(), "PublicationId")
    kinds = dict(paa.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["PublicationId", "CitedPublicationId"])
        at, ids = pd.factorize(pdf["PublicationId"])
        ids = ids.tolist()
        cited = pd.factorize(pdf["CitedPublicationId"])[0]
        # References in order, each with its citers in order; those of one citer make no links.
        order = np.lexsort((at, cited))
        size = np.bincount(cited)
        ends = np.cumsum(size)
        found = [np.empty(0, dtype=np.int64)]
        for k in np.flatnonzero(size > 1):
            own = at[order[ends[k] - size[k] : ends[k]]].astype(np.int64)
            i, j = np.triu_indices(len(own), 1)
            found.append(own[i] * len(ids) + own[j])
        links = [divmod(x, len(ids)) for x in np.unique(np.concatenate(found)).tolist()]
        parent = list(range(len(ids)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for a, b in links:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        roots = [root(i) for i in range(len(ids))]
        members = Counter(roots)
        big = min(members, key=lambda r: (-members[r], r))
        keep = [i for i, r in enumerate(roots) if r == big]
        number = {v: k for k, v in enumerate(keep)}
        own = [(number[a], number[b], 1.0) for a, b in links if a in number]
        topics = louvain([ids[v] for v in keep], own)
        degree = np.bincount([x for a, b, _ in own for x in (a, b)], minlength=len(keep)) if own else [0] * len(keep)
        years = pdf.drop_duplicates("PublicationId")[year].tolist()
        out = pd.DataFrame({"PublicationId": [ids[v] for v in keep], year: [years[v] for v in keep], "TopicCommunity": topics, "Degree": [int(d) for d in degree]})
        out.insert(0, "AuthorId", pdf["AuthorId"].iloc[0])
        return out.sort_values([year, "PublicationId"])

    return refs.groupBy("AuthorId").applyInPandas(run, f"AuthorId {kinds['AuthorId']}, PublicationId {kinds['PublicationId']}, {year} {kinds[year]}, TopicCommunity int, Degree int")
