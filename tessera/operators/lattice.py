"""Forward and backward sums of hidden Markov chains, many chains at a time.

Chains, or blocks of chains, come as one row each with their emissions as nested arrays; a batch of
them is padded and swept together, row number by row number. A long chain may be cut into blocks:
products of log transition matrices are associative, so each block's product is found apart, a scan
over a chain's blocks (a matrix each) tells every block what enters it and what follows it, and
blocks are then finished apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from .fit import TERMS

#: Numbers of a padded batch at most.
CELLS = 4_000_000
#: What a pass over chains leaves: a law's distinct pairs with each state's summed posteriors, or, under "sum", the sum of place x in the first entry of ``w``.
PAIRS = "law string, model int, x double, n double, purity double, w array<double>"


def lse(a: np.ndarray, axis: int) -> np.ndarray:
    """log(sum(exp)) along an axis; -inf where all are."""
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def switched(log_trans: np.ndarray, log_switch: np.ndarray | None) -> np.ndarray:
    """Transitions [B, S, S] into the next row: the states' own, or with phase switches twice as many states."""
    if log_switch is None:
        return log_trans
    s = np.clip(log_switch[:, None, None], -700, np.log(0.5))
    keep = np.log1p(-np.exp(s))
    return np.concatenate([np.concatenate([keep + log_trans, s + log_trans], axis=2), np.concatenate([s + log_trans, keep + log_trans], axis=2)], axis=1)


class Batch:
    """Padded blocks: emissions [B, L, S], sizes falling, transitions [B, K, K], log switches [B, L] or None."""

    def __init__(self, em: np.ndarray, size: np.ndarray, trans: np.ndarray, switch: np.ndarray | None) -> None:
        self.em, self.size, self.trans, self.switch = em, size, trans, switch

    def step(self, t: int, m: int) -> np.ndarray:
        """Transitions out of row t of the first m blocks."""
        return switched(self.trans[:m], None if self.switch is None else self.switch[:m, t])

    def last(self) -> np.ndarray:
        """Transitions out of every block's last row."""
        rows = np.arange(len(self.size))
        return switched(self.trans, None if self.switch is None else self.switch[rows, self.size - 1])

    def longer(self, t: int) -> int:
        """How many blocks have a row t."""
        return int(np.searchsorted(-self.size, -t))

    def product(self) -> np.ndarray:
        """[B, S, S]: log weight from each state at the first row, its emission included, to each at the last."""
        states = self.em.shape[2]
        out = np.where(np.eye(states, dtype=bool), self.em[:, 0, None, :], -np.inf)
        for t in range(1, self.em.shape[1]):
            m = self.longer(t)
            out[:m] = lse(out[:m, :, :, None] + self.step(t - 1, m)[:, None], 2) + self.em[:m, t, None, :]
        return out

    def posteriors(self, entry: np.ndarray, after: np.ndarray, goes_on: np.ndarray, llf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log posteriors [B, L, S], expected transitions [B, S, S], log-likelihoods).

        ``entry``: log weight of each state before the first row's emission; where ``goes_on``, a
        block's last row is followed by one whose states weigh ``after``, and the chain's ``llf`` is known.
        """
        blocks, length, states = self.em.shape
        alpha, beta = np.zeros_like(self.em), np.zeros_like(self.em)
        rows, end = np.arange(blocks), self.size - 1
        alpha[:, 0] = entry + self.em[:, 0]
        for t in range(1, length):
            m = self.longer(t)
            alpha[:m, t] = self.em[:m, t] + lse(alpha[:m, t - 1, :, None] + self.step(t - 1, m), 1)
        out = self.last() + after[:, None, :]
        beta[rows, end] = np.where(goes_on[:, None], lse(np.where(goes_on[:, None, None], out, 0.0), 2), 0.0)
        llf = np.where(np.isnan(llf), lse(alpha[rows, end] + beta[rows, end], 1), llf)
        moves = np.where(goes_on[:, None, None], np.exp(np.where(goes_on[:, None, None], alpha[rows, end][:, :, None] + out - llf[:, None, None], 0.0)), 0.0)
        for t in range(length - 2, -1, -1):
            m = self.longer(t + 1)
            into = self.step(t, m) + (self.em[:m, t + 1] + beta[:m, t + 1])[:, None, :]
            beta[:m, t] = lse(into, 2)
            moves[:m] += np.exp(alpha[:m, t, :, None] + into - llf[:m, None, None])
        if not np.isfinite(llf).all():
            raise ValueError("a chain has no possible path: all posteriors of a row are zero")
        return alpha + beta - llf[:, None, None], moves, llf


def batches(rows: pa.RecordBatch, trans: np.ndarray, phased: bool) -> Iterator[tuple[np.ndarray, Batch]]:
    """(numbers of the rows, their padded blocks) of a record batch with columns _model, em and, if ``phased``, switch.

    ``trans``: [model, K, K].
    """
    em = rows.column("em")
    sizes = np.diff(em.offsets.to_numpy())
    flat = em.flatten()
    states = len(flat[0]) if len(flat) else 1
    flat = np.asarray(flat.flatten(), float).reshape(-1, states)
    for at, _, batch in padded(sizes, flat, rows.column("_model").to_numpy(), _switches(rows) if phased else None, trans):
        yield at, batch


def _switches(rows: pa.RecordBatch) -> np.ndarray:
    return np.asarray(rows.column("switch").flatten().fill_null(-np.inf), float)


def padded(sizes: np.ndarray, flat: np.ndarray, model: np.ndarray, switch: np.ndarray | None, trans: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Batch]]:
    """(numbers of the blocks, places of their rows, padded blocks) of blocks of ``sizes`` rows that lie one after the other in ``flat``."""
    begin = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(-sizes, kind="stable")
    lo = 0
    while lo < len(order):
        most = max(1, CELLS // max(int(sizes[order[lo]]) * flat.shape[1], 1))
        at = order[lo : lo + most]
        lo += most
        length = int(sizes[at[0]])
        place = begin[at][:, None] + np.minimum(np.arange(length)[None], sizes[at][:, None] - 1)
        yield at, place, Batch(flat[place], sizes[at], trans[model[at]], None if switch is None else switch[place])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of x > 0, by the series of ``columns.lgamma``."""
    z, shift = x + 8.0, x.copy()
    for k in range(1, 8):
        shift *= x + k
    r2 = 1 / (z * z)
    series = (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 * (1 / 1680 - r2 / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def _where(ok: np.ndarray, found: Callable, *xs: np.ndarray) -> np.ndarray:
    """``found`` of the rows that are ``ok``, 0 elsewhere."""
    out = np.zeros(len(ok))
    out[ok] = found(*(x[ok] for x in xs))
    return out


def nb_emissions(k: np.ndarray, base: np.ndarray, log_mu: np.ndarray, alpha: np.ndarray, purity: np.ndarray | None) -> np.ndarray:
    """``columns.nb_emission``."""

    def found(k: np.ndarray, grown: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _lgamma(k + n) - _lgamma(n) - _lgamma(k + 1) + k * np.log(grown) - (k + n) * np.log1p(grown)

    rate = np.exp(log_mu) if purity is None else purity * np.exp(log_mu) + 1 - purity
    return _where((base > 0) & (k >= 0), found, k, alpha * base * rate, 1 / alpha)


def bb_emissions(k: np.ndarray, n: np.ndarray, p: np.ndarray, tau: np.ndarray, purity: np.ndarray | None) -> np.ndarray:
    """``columns.bb_emission``."""

    def found(k: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        plus = _lgamma(n + 1) + _lgamma(k + a) + _lgamma(n - k + b) + _lgamma(a + b)
        return plus - _lgamma(k + 1) - _lgamma(n - k + 1) - _lgamma(n + a + b) - _lgamma(a) - _lgamma(b)

    share = p if purity is None else p * purity + 0.5 * (1 - purity)
    a, b = share * tau, (1 - share) * tau
    return _where((n > 0) & (a > 0) & (b > 0) & (k >= 0) & (k <= n), found, k, n, a, b)


def emitter(p: np.ndarray, tau: np.ndarray, log_mu: np.ndarray | None, alpha: np.ndarray | None, phased: bool, purity: str | None) -> Callable:
    """Adds ``em``, the log-emissions of each row's states, to rows of blocks (_model, umi, base, k, depth, [purity]).

    Parameters are [model, state]; without ``log_mu`` read counts don't count.
    """

    def emit(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in given:
            if not rows.num_rows:
                continue
            lists = rows.column("k")
            flat = {c: np.asarray(rows.column(c).flatten().cast(pa.float64()).fill_null(np.nan)) for c in ("umi", "base", "k", "depth", *([purity] if purity else []))}
            model, q = np.repeat(rows.column("_model").to_numpy(), np.diff(lists.offsets.to_numpy())), flat[purity] if purity else None
            kept, turned = [], []
            for s in range(p.shape[1]):
                reads = 0.0 if log_mu is None else nb_emissions(flat["umi"], flat["base"], log_mu[model, s], alpha[model, s], q)
                kept.append(reads + bb_emissions(flat["k"], flat["depth"], p[model, s], tau[model, s], q))
                if phased:
                    turned.append(reads + bb_emissions(flat["depth"] - flat["k"], flat["depth"], p[model, s], tau[model, s], q))
            em = np.stack([*kept, *turned], axis=1)
            states = pa.ListArray.from_arrays(pa.array(np.arange(len(em) + 1) * em.shape[1], pa.int32()), pa.array(em.ravel()))
            begin = lists.offsets.to_numpy()
            yield rows.append_column("em", pa.ListArray.from_arrays(pa.array(begin - begin[0], pa.int32()), states))

    return emit


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct tuple, number of every row's tuple)."""
    of = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own, values = pd.factorize(c, use_na_sentinel=False)
        of = pd.factorize(of * max(len(values), 1) + own)[0]
    first = np.zeros(of.max(initial=-1) + 1, np.int64)
    first[of[::-1]] = np.arange(len(of))[::-1]
    return first, of


def sum_shapes(k: int) -> dict[str, tuple[int, ...]]:
    """Sums of a model of k states, in order: transitions, starts, likelihood, rows, and of each law the states' weights and six terms."""
    return {"moves": (k, k), "starts": (k,), "llf": (), "rows": (), "nb": (k,), "bb": (k,), "nb_terms": (k, 6), "bb_terms": (k, 6)}


def pair_counter(p: np.ndarray, tau: np.ndarray, log_mu: np.ndarray | None, alpha: np.ndarray | None, start: np.ndarray, trans: np.ndarray, phased: bool, purity: str | None, laws: list[str], points: dict[str, np.ndarray], decimals: int = 3) -> Callable:
    """``PAIRS`` from rows of blocks (_model, umi, base, k, depth, [purity], [switch]): posteriors summed where they arise, so that no row of them leaves the pass.

    Parameters are [model, state], as in ``emitter``. An emission, and a term at ``points[law][model, state, 0]``, is computed once for equal rows of a batch.
    """
    k, models = p.shape[1], len(trans)

    def rounded(x: np.ndarray) -> np.ndarray:
        return np.floor(x * 10**decimals + 0.5) / 10**decimals

    def count(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in given:
            if not rows.num_rows:
                continue
            sizes, own = np.asarray(rows.column("k").value_lengths()), rows.column("_model").to_numpy()
            model = np.repeat(own, sizes)
            umi, base, kept, depth, *pure = (np.asarray(rows.column(c).flatten().cast(pa.float64()).fill_null(np.nan)) for c in ("umi", "base", "k", "depth", *([purity] if purity else [])))
            reads, alleles = distinct(model, umi, base, *pure), distinct(model, kept, depth, *pure)

            def each(found: Callable, pairs: tuple, x: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
                """Emissions [row, state]."""
                first, of = pairs
                m, q = model[first], pure[0][first] if pure else None  # noqa: B023
                return np.stack([found(x[first], n[first], a[m, s], b[m, s], q) for s in range(k)], axis=1)[of]

            by_reads = 0.0 if log_mu is None else each(nb_emissions, reads, umi, base, log_mu, alpha)
            parts = [by_reads + each(bb_emissions, alleles, x, depth, p, tau) for x in ((kept, depth - kept) if phased else (kept,))]
            em = np.concatenate(parts, axis=1)
            post, sums = np.empty_like(em), {name: np.zeros((models, *shape)) for name, shape in sum_shapes(k).items()}
            for at, place, batch in padded(sizes, em, own, _switches(rows) if phased else None, trans):
                n = len(at)
                gamma, moves, llf = batch.posteriors(start[own[at]], np.zeros((n, em.shape[1])), np.zeros(n, bool), np.full(n, np.nan))
                held = np.arange(gamma.shape[1])[None] < batch.size[:, None]
                post[place[held]] = np.exp(gamma[held])
                # Both phases of a state count.
                opens, moves = np.exp(gamma[:, 0]).reshape(n, -1, k).sum(axis=1), moves.reshape(n, -1, k, moves.shape[1] // k, k).sum(axis=(1, 3))
                for name, v in (("moves", moves), ("starts", opens), ("llf", llf), ("rows", batch.size)):
                    np.add.at(sums[name], own[at], v)
            out = []

            def pairs(law: str, found: tuple, x: np.ndarray, n: np.ndarray, w: np.ndarray) -> None:
                first, of = found
                ok = (n[first] > 0) & np.isfinite(x[first] + (pure[0][first] if pure else 0.0))  # noqa: B023
                held, first = np.stack([np.bincount(of, w[:, s], len(first)) for s in range(k)], axis=1)[ok], first[ok]
                m, x, n, q = model[first], x[first], rounded(n[first]), rounded(pure[0][first]) if pure else None  # noqa: B023
                np.add.at(sums[law], m, held)  # noqa: B023
                for s in range(k if law in points else 0):
                    with np.errstate(all="ignore"):
                        terms = np.stack(TERMS[law](x, n, points[law][m, s, 0, 0], points[law][m, s, 0, 1], q), axis=1) * held[:, s, None]
                    np.add.at(sums[f"{law}_terms"][:, s], m, np.where(held[:, s, None] > 0, terms, 0.0))  # noqa: B023
                out.append((law, m, x, n, q, held))  # noqa: B023

            if "nb" in laws:
                pairs("nb", reads, umi, base, post[:, :k] + post[:, k:] if phased else post)
            if "bb" in laws:
                pairs("bb", alleles, kept, depth, post[:, :k])
                if phased:
                    pairs("bb", alleles, depth - kept, depth, post[:, k:])
            flat = np.concatenate([v.reshape(models, -1) for v in sums.values()], axis=1)
            met = np.unique(own)
            first = np.zeros((len(met) * flat.shape[1], k))
            first[:, 0] = flat[met].ravel()
            out.append(("sum", np.repeat(met, flat.shape[1]), np.tile(np.arange(flat.shape[1], dtype=float), len(met)), np.zeros(len(first)), None, first))
            for law, m, x, n, q, w in out:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([law] * len(w), pa.string()), pa.array(m, pa.int32()), pa.array(x), pa.array(n), pa.nulls(len(w), pa.float64()) if q is None else pa.array(q), lists], ["law", "model", "x", "n", "purity", "w"])

    return count


def finisher(keys: list[str], order: str, start: np.ndarray, trans: np.ndarray, phased: bool, scanned: bool, carry: list[str]) -> Callable:
    """Rows of posteriors, with the columns ``carry``, from rows of blocks (keys, _model, t, em, [switch], carried arrays, and where ``scanned`` entry, after, llf, first)."""

    def finish(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in given:
            if not rows.num_rows:
                continue
            model = rows.column("_model").to_numpy()
            for at, batch in batches(rows, trans, phased):
                states = batch.em.shape[2]
                if scanned:
                    follow = rows.column("after").take(pa.array(at))
                    goes_on = ~np.asarray(follow.is_null())
                    after = np.zeros((len(at), states))
                    after[goes_on] = np.array(follow.drop_null().flatten(), float).reshape(-1, states)
                    entry = np.array(rows.column("entry").take(pa.array(at)).flatten(), float).reshape(-1, states)
                    llf, first = rows.column("llf").to_numpy()[at], np.asarray(rows.column("first").take(pa.array(at)))
                else:
                    after, goes_on, entry = np.zeros((len(at), states)), np.zeros(len(at), bool), start[model[at]]
                    llf, first = np.full(len(at), np.nan), np.ones(len(at), bool)
                gamma, moves, llf = batch.posteriors(entry, after, goes_on, llf)
                k = trans.shape[1]
                if phased:
                    moves = moves[:, :k, :k] + moves[:, :k, k:] + moves[:, k:, :k] + moves[:, k:, k:]
                held = np.arange(gamma.shape[1])[None] < batch.size[:, None]
                flat, total = gamma[held], int(batch.size.sum())
                best = flat.argmax(axis=1)
                opens = np.zeros(total, bool)
                opens[np.concatenate([[0], np.cumsum(batch.size)[:-1]])] = True
                back = pa.array(np.repeat(at, batch.size))
                t, *carried = (rows.column(c).take(pa.array(at)).flatten() for c in ("t", *carry))
                moved, likely = np.full(total, None, object), np.full(total, np.nan)
                for place, m in zip(np.flatnonzero(opens), moves, strict=True):
                    moved[place] = m.ravel().tolist()
                likely[opens] = np.where(first, llf, np.nan)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(total + 1) * states, pa.int32()), pa.array(flat.ravel()))
                found = [lists, pa.array((best % k).astype(np.int32)), pa.array(best < k), pa.array(moved.tolist(), pa.list_(pa.float64())), pa.array(likely, from_pandas=True)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(back) for c in keys), t, *found, *carried], [*keys, order, "log_gamma", "state", "phase", "xi", "llf", *carry])

    return finish


def multiplier(keys: list[str], trans: np.ndarray, phased: bool) -> Callable:
    """Rows (keys, _model, cut, product, [switch of the last row]) from rows of blocks."""

    def multiply(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in given:
            for at, batch in batches(rows, trans, phased) if rows.num_rows else ():
                back = pa.array(at)
                last = pa.array(batch.switch[np.arange(len(at)), batch.size - 1]) if phased else pa.nulls(len(at), pa.float64())
                flat = batch.product().reshape(len(at), -1)
                product = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(back) for c in (*keys, "_model", "cut")), product, last], [*keys, "_model", "cut", "product", "switch"])

    return multiply


def scanner(keys: list[str], start: np.ndarray, trans: np.ndarray, phased: bool) -> Callable:
    """Rows (keys, cut, entry, after, llf, first) from rows of chains (keys, _model, cuts, products, switches)."""

    def scan(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in given:
            for row in range(rows.num_rows):
                model, cuts, products, switches = (rows.column(c)[row].as_py() for c in ("_model", "cuts", "products", "switches"))
                entry = [start[model]]
                states, own = len(start[model]), trans[model][None]
                products = [np.array(p).reshape(states, states) for p in products]
                out = [switched(own, np.array([s]) if phased else None)[0] for s in switches]
                for p, o in zip(products, out, strict=True):
                    leaves = lse(entry[-1][:, None] + p, 0)
                    entry.append(lse(leaves[:, None] + o, 0))
                total, follow = float(lse(leaves, 0)), np.zeros(states)
                after: list = [None]
                for p, o in zip(products[:0:-1], out[-2::-1], strict=True):
                    follow = lse(p + follow[None], 1)
                    after.append(follow.tolist())
                    follow = lse(o + follow[None], 1)
                n = len(cuts)
                columns = [pa.array(cuts), pa.array([e.tolist() for e in entry[:n]], pa.list_(pa.float64())), pa.array(after[::-1], pa.list_(pa.float64())), pa.array([total] * n), pa.array([True] + [False] * (n - 1))]
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array([row] * n)) for c in keys), *columns], [*keys, "cut", "entry", "after", "llf", "first"])

    return scan
