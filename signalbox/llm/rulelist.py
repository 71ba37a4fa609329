"""Ordered rule lists by incremental reduced-error pruning, and the learned list of the quality verdict.

``fit`` learns, for a binary label, a list of conjunctions of threshold tests: each rule is grown on two thirds of the
rows that no rule covers yet by adding the test with the best information gain, pruned from its end on the other third,
and kept while it is right more often than not there. Rows no rule covers get the default. ``case_expression`` turns a
list into SQL.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np

#: Labelled rows that ``fit`` takes at most; a sample beyond that is the caller's.
MAX_ROWS = 50_000
_CUTS = 64  # thresholds tried for each feature: quantiles of the rows at hand


@dataclass(frozen=True)
class Test:
    """``feature <= cut`` or ``feature > cut``."""

    feature: str
    below: bool
    cut: float

    def holds(self, column: np.ndarray) -> np.ndarray:
        return column <= self.cut if self.below else column > self.cut


@dataclass(frozen=True)
class RuleList:
    """Rules that say True, in order, and the default."""

    rules: tuple[tuple[Test, ...], ...]
    default: bool = False

    def predict(self, features: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(features.values())))
        out, open_ = np.full(n, self.default), np.ones(n, bool)
        for rule in self.rules:
            hit = open_.copy()
            for t in rule:
                hit &= t.holds(features[t.feature])
            out[hit] = not self.default
            open_ &= ~hit
        return out


def _covers(rule: Sequence[Test], x: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    keep = np.ones(len(rows), bool)
    for t in rule:
        keep &= t.holds(x[t.feature][rows])
    return rows[keep]


def _grow(x: dict[str, np.ndarray], y: np.ndarray, rows: np.ndarray) -> list[Test]:
    rule: list[Test] = []
    while len(rows) and not y[rows].all():
        base = np.log2(max(y[rows].mean(), 1e-9))
        best, gain = None, 1e-9
        for name, col in x.items():
            v, target = col[rows], y[rows]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, _CUTS + 1), method="midpoint")):
                for below in (True, False):
                    hit = v <= cut if below else v > cut
                    p = int(target[hit].sum())
                    if p and (g := p * (np.log2(p / hit.sum()) - base)) > gain:
                        best, gain = Test(name, below, float(cut)), g
        if best is None:
            break
        rule.append(best)
        rows = _covers([best], x, rows)
    return rule


def fit(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 7, max_rules: int = 24) -> RuleList:
    """Learn a rule list for the rarer class of ``y`` from at most MAX_ROWS rows."""
    n = len(y)
    if n > MAX_ROWS:
        raise ValueError(f"at most {MAX_ROWS} labelled rows")
    target = np.asarray(y, bool)
    default = bool(target.mean() > 0.5)
    want = ~target if default else target
    rng, left, rules = np.random.default_rng(seed), np.arange(n), []
    while want[left].any() and len(rules) < max_rules:
        order = rng.permutation(left)
        grow, prune = order[: 2 * len(order) // 3], order[2 * len(order) // 3 :]
        rule = _grow(x, want, grow)
        worth = []
        for k in range(1, len(rule) + 1):
            hit = _covers(rule[:k], x, prune)
            p = int(want[hit].sum())
            worth.append((p - (len(hit) - p)) / max(len(hit), 1))
        if not worth or max(worth) <= 0:
            break
        rule = rule[: int(np.argmax(worth)) + 1]
        rules.append(tuple(rule))
        left = np.setdiff1d(left, _covers(rule, x, left), assume_unique=True)
    return RuleList(tuple(rules), default)


def case_expression(rules: RuleList, prefix: str = "") -> str:
    """The list as a SQL CASE expression over columns ``prefix + feature``."""
    say = str(not rules.default).lower()
    arms = [
        "WHEN " + " AND ".join(f"{prefix}{t.feature} {'<=' if t.below else '>'} {t.cut!r}D" for t in rule) + f" THEN {say}"
        for rule in rules.rules
    ]
    return f"CASE {' '.join(arms)} ELSE {str(rules.default).lower()} END" if arms else str(rules.default).lower()


def save(rules: RuleList, path: Path) -> None:
    """Write a list as JSON."""
    data = {"default": rules.default, "rules": [[[t.feature, "<=" if t.below else ">", t.cut] for t in r] for r in rules.rules]}
    path.write_text(json.dumps(data, indent=1) + "\n")


def read(path: Path) -> RuleList:
    """Read a list from JSON."""
    data = json.loads(path.read_text())
    return RuleList(tuple(tuple(Test(f, op == "<=", cut) for f, op, cut in r) for r in data["rules"]), data["default"])


#: The learned list: true for passages of natural prose. Written by ``quality_training``.
LEARNED = Path(__file__).with_name("prose_rules.json")
RULES = read(LEARNED) if LEARNED.exists() else RuleList((), True)
