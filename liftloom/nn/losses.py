"""Losses and imbalance measures on tensors.

Outcome losses take predictions ``y0`` and ``y1`` [n, outputs], treatment ``t`` and outcome ``y`` [n, 1], and where
they use it a propensity logit or estimate.  ``outputs`` says how wide a head they need and ``decode`` turns a head
into an outcome.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import tape as T
from .tape import Tensor

LOG_2PI = float(np.log(2 * np.pi))


def chosen(y0: Tensor, y1: Tensor, t: np.ndarray) -> Tensor:
    """The prediction of each row's own arm."""
    return y1 * t + y0 * (1 - t)


class Loss:
    outputs = 1

    def decode(self, head: np.ndarray) -> np.ndarray:
        return head[:, 0]

    def __call__(self, y0: Tensor, y1: Tensor, t: np.ndarray, y: np.ndarray, **extra) -> Tensor:
        raise NotImplementedError


class MSELoss(Loss):
    def __call__(self, y0, y1, t, y, **extra):
        return T.square(chosen(y0, y1, t) - y).mean()


class MAELoss(Loss):
    def __call__(self, y0, y1, t, y, **extra):
        return T.absolute(chosen(y0, y1, t) - y).mean()


@dataclass
class PseudoPEHE(Loss):
    """Squared gap of the mean predicted effect and the self-normalised weighted estimate of it."""

    eps: float = 1e-8

    def __call__(self, y0, y1, t, y, propensity=None, **extra):
        e = np.clip(propensity if propensity is not None else np.full_like(y, t.mean()), self.eps, 1 - self.eps)
        w1, w0 = t / e, (1 - t) / (1 - e)
        ate = (w1 * y).sum() / (w1.sum() + self.eps) - (w0 * y).sum() / (w0.sum() + self.eps)
        return T.square((y1 - y0).mean() - ate)


@dataclass
class TwoStageLoss(Loss):
    """Conversion (y > 0) by cross-entropy and value among converters by squared error."""

    value_weight: float = 1.0
    outputs = 2

    def decode(self, head):
        return T._sigmoid(head[:, 0]) * head[:, 1]

    def __call__(self, y0, y1, t, y, **extra):
        p = chosen(y0, y1, t)
        bought = (y > 0).astype(float)
        value = (T.square(p[:, 1:2] - y) * bought).sum() * (1.0 / max(1.0, bought.sum()))
        return T.bce(p[:, 0:1], bought).mean() + value * self.value_weight


def zero_inflated_lognormal_pred(logits: np.ndarray) -> np.ndarray:
    scale = np.minimum(np.logaddexp(0, logits[:, 2]) + 1e-6, 5.0)
    return T._sigmoid(logits[:, 0]) * np.exp(np.clip(logits[:, 1], -10, 10) + scale**2 / 2)


def _lognormal_nll(y: np.ndarray, loc: Tensor, scale: Tensor) -> Tensor:
    z = (np.log(np.maximum(y, 1e-12)) - loc) / scale
    return T.square(z) * 0.5 + T.log(scale) + np.log(np.maximum(y, 1e-12)) + 0.5 * LOG_2PI


def ziln(y: np.ndarray, logits: Tensor, weight: np.ndarray | None = None) -> Tensor:
    """Mean negative log-likelihood of a zero-inflated lognormal, over rows with ``weight`` 1."""
    weight = np.ones_like(y) if weight is None else weight
    positive = (y > 0).astype(float)
    scale = T.clip(T.softplus(logits[:, 2:3]) + 1e-6, 1e-6, 5.0)
    nll = _lognormal_nll(y, T.clip(logits[:, 1:2], -np.inf, 11.0), scale) * positive
    return ((T.bce(logits[:, 0:1], positive) + nll) * weight).sum() * (1.0 / max(1.0, weight.sum()))


def zero_inflated_lognormal_loss(labels: np.ndarray, logits: Tensor) -> Tensor:
    """Per-row lognormal likelihood of positive labels plus the mean cross-entropy of being positive."""
    positive = (labels > 0).astype(float)
    scale = T.softplus(logits[:, 2:3]) + 1e-6
    return _lognormal_nll(labels, logits[:, 1:2], scale) * positive + T.bce(logits[:, 0:1], positive).mean()


def _mean(logits: Tensor) -> Tensor:
    scale = T.clip(T.softplus(logits[:, 2:3]) + 1e-6, 1e-6, 5.0)
    return T.sigmoid(logits[:, 0:1]) * T.exp(T.clip(logits[:, 1:2], -10.0, 10.0) + T.square(scale) * 0.5)


def within_group_rank(pred: Tensor, y: np.ndarray) -> Tensor:
    """Mean over all pairs of the squared gap between differences of predictions and of outcomes, where their signs contradict."""
    if not len(y):
        return Tensor(0.0)
    gap, truth = pred - pred.T, y - y.T
    return (T.square(gap - truth) * (gap.data * truth < 0).astype(float)).mean()


def cross_group_rank(pred_t: Tensor, pred_c: Tensor, y_t: np.ndarray, y_c: np.ndarray) -> Tensor:
    """The same over pairs of a treated and a control row, seen from both arms: predicted against observed of the other arm."""
    if not len(y_t) or not len(y_c):
        return Tensor(0.0)
    gap = (pred_t - y_c.T) + (pred_c.T - y_t)
    wrong = ((pred_t.data - y_c.T) * (y_t - pred_c.data.T) < 0).astype(float)
    return (T.square(gap) * wrong).mean() * 2.0  # both arms give the same pairs with roles changed


def listwise_uplift_rank(uplift: Tensor, t: np.ndarray, y: np.ndarray) -> Tensor:
    """Outcome-weighted log-softmax of effects: raised for treated rows, lowered for control rows."""
    weight = T.log_softmax(uplift, 0)
    n1, n0 = max(1.0, t.sum()), max(1.0, (1 - t).sum())
    return -(weight * (t * y)).sum() * (1 / n1) + (weight * ((1 - t) * y)).sum() * (1 / n0)


def targeted(m0: Tensor, m1: Tensor, t: np.ndarray, y: np.ndarray, logit: Tensor, epsilon: Tensor) -> Tensor:
    """Targeted regularisation: outcomes perturbed along the clever covariate of the propensity."""
    e = (T.sigmoid(logit) + 0.01) / 1.02
    h = t / e - (1 - t) / (1 - e)
    return T.square(chosen(m0, m1, t) + epsilon * h - y).mean()


@dataclass
class DragonNetLoss(Loss):
    """Zero-inflated lognormal outcomes with rankings, propensity cross-entropy and targeted regularisation."""

    uplift_ranking_weight: float = 1e-10
    outcome_ranking_weight: float = 1e-20
    alpha: float = 1.0
    beta: float = 0.0
    outputs = 3

    def decode(self, head):
        return zero_inflated_lognormal_pred(head)

    def __call__(self, y0, y1, t, y, logit=None, epsilon=None, **extra):
        loss = ziln(y, y1, t) + ziln(y, y0, 1 - t)
        m1, m0 = _mean(y1), _mean(y0)
        if self.outcome_ranking_weight:
            loss = loss + within_group_rank(chosen(m0, m1, t), y) * self.outcome_ranking_weight
        if self.uplift_ranking_weight:
            loss = loss + listwise_uplift_rank(m1 - m0, t, y) * self.uplift_ranking_weight
        if logit is not None:
            loss = loss + T.bce(logit, t).mean() * self.alpha
            if self.beta and epsilon is not None:
                loss = loss + targeted(m0, m1, t, y, logit, epsilon) * self.beta
        return loss


@dataclass
class RERUMLoss(DragonNetLoss):
    """Zero-inflated lognormal outcomes with response and listwise uplift rankings.

    The pairwise terms take all rows of a batch's arm, or ``ranking_sample_size`` drawn ones; the listwise term takes all.
    """

    within_ranking_weight: float = 1e-4
    cross_ranking_weight: float = 0.0
    listwise_ranking_weight: float = 10.0
    ranking_sample_size: int | None = None
    imbalance: str | None = None
    p_alpha: float = 0.0
    draws: np.random.Generator = field(default_factory=lambda: np.random.default_rng(0), repr=False, compare=False)

    def drawn(self, rows: np.ndarray) -> np.ndarray:
        if self.ranking_sample_size is None or len(rows) <= self.ranking_sample_size:
            return rows
        return self.draws.permutation(rows)[: self.ranking_sample_size]

    def __call__(self, y0, y1, t, y, logit=None, epsilon=None, rep=None, **extra):
        loss = ziln(y, y1, t) + ziln(y, y0, 1 - t)
        m1, m0 = _mean(y1), _mean(y0)
        treated, control = (self.drawn(np.flatnonzero(t[:, 0] == a)) for a in (1, 0))
        if self.within_ranking_weight:
            loss = loss + (within_group_rank(m1[treated], y[treated]) + within_group_rank(m0[control], y[control])) * self.within_ranking_weight
        if self.cross_ranking_weight:
            loss = loss + cross_group_rank(m1[treated], m0[control], y[treated], y[control]) * self.cross_ranking_weight
        loss = loss + listwise_uplift_rank(m1 - m0, t, y) * self.listwise_ranking_weight
        if logit is not None:
            loss = loss + T.bce(logit, t).mean() * self.alpha
            if self.beta and epsilon is not None:
                loss = loss + targeted(m0, m1, t, y, logit, epsilon) * self.beta
        if self.imbalance and self.p_alpha and rep is not None:
            loss = loss + compute_imbalance(rep, t, self.imbalance) * self.p_alpha
        return loss


# ---------------------------------------------------------------- imbalance of representations


def _groups(rep: Tensor, t: np.ndarray, e: np.ndarray | None) -> tuple[Tensor, Tensor, np.ndarray, np.ndarray]:
    """Rows and normalised weights (t / 2e and (1 - t) / 2(1 - e)) of both arms."""
    a, b = np.flatnonzero(t[:, 0] == 1), np.flatnonzero(t[:, 0] == 0)
    e = np.full_like(t, 0.5) if e is None else e
    w1, w0 = 1 / (2 * e[a]), 1 / (2 * (1 - e[b]))
    return rep[a], rep[b], w1 / max(w1.sum(), 1e-12), w0 / max(w0.sum(), 1e-12)


def _distances2(a: Tensor, b: Tensor) -> Tensor:
    return T.square(a).sum(1, True) + T.square(b).sum(1, True).T - (a @ b.T) * 2.0


def mmd2_lin(rep: Tensor, t: np.ndarray, e: np.ndarray | None = None) -> Tensor:
    a, b, wa, wb = _groups(rep, t, e)
    return T.square((a * wa).sum(0) - (b * wb).sum(0)).sum()


def lindisc(rep: Tensor, e: np.ndarray | None, t: np.ndarray) -> Tensor:
    return T.safe_sqrt(mmd2_lin(rep, t, e))


def mmd2_rbf(rep: Tensor, t: np.ndarray, e: np.ndarray | None = None, sigma: float = 0.1) -> Tensor:
    a, b, wa, wb = _groups(rep, t, e)
    kernel = lambda x, y: T.exp(_distances2(x, y) * (-1 / (2 * sigma**2)))
    return (kernel(a, a) * (wa @ wa.T)).sum() + (kernel(b, b) * (wb @ wb.T)).sum() - (kernel(a, b) * (wa @ wb.T)).sum() * 2.0


def wasserstein(rep: Tensor, t: np.ndarray, lam: float = 10.0, its: int = 50, sq: bool = False) -> tuple[Tensor, Tensor]:
    """Entropic optimal transport between the arms, each row of an arm weighing the same: the distance and the plan [treated, control].

    Each half step scales anew to the arm's weights, so the plan keeps them and no number of iterations overflows.
    """
    a, b, *_ = _groups(rep, t, None)
    n1, n0 = a.shape[0], b.shape[0]
    if not n1 or not n0:
        return Tensor(0.0), Tensor(0.0)
    cost = T.clip(_distances2(a, b), 0.0, np.inf)
    cost = cost if sq else T.safe_sqrt(cost)
    kernel = T.exp(cost * (-1 / lam))
    one, zero = Tensor(np.full((n1, 1), 1 / n1)), Tensor(np.full((n0, 1), 1 / n0))
    rows, columns = one, zero
    for _ in range(max(1, its)):
        rows = one / (kernel @ columns + 1e-9)
        columns = zero / (kernel.T @ rows + 1e-9)
    plan = rows * kernel * columns.T
    return (cost * plan).sum(), plan


@dataclass
class Imbalance:
    """What ``imbalance`` found: the term for a loss, the distance, and the plan of a Wasserstein kind."""

    loss: Tensor
    distance: Tensor
    plan: Tensor | None = None


def imbalance(rep: Tensor, t: np.ndarray, kind: str = "mmd2_lin", e: np.ndarray | None = None, sigma: float = 0.1, lam: float = 10.0, its: int = 50, r_alpha: float = 1.0, through_plan: bool = False) -> Imbalance:
    """Distance of the arms' representations, times ``r_alpha``; without ``through_plan`` the plan is handed out without its gradient.

    Kinds: mmd2_rbf, mmd_rbf, mmd2_lin, mmd_lin, wass, wass2; any other is the linear discrepancy.
    """
    if not (t == 1).any() or not (t == 0).any():
        return Imbalance(Tensor(0.0), Tensor(0.0))
    if kind in ("wass", "wass2"):
        distance, plan = wasserstein(rep, t, lam, its, kind == "wass2")
        return Imbalance(distance * r_alpha, distance, plan if through_plan else Tensor(plan.data))
    if kind in ("mmd2_rbf", "mmd_rbf"):
        distance = mmd2_rbf(rep, t, e, sigma)
        distance = T.absolute(distance) if kind == "mmd_rbf" else distance
    else:
        distance = mmd2_lin(rep, t, e) if kind in ("mmd2_lin", "mmd_lin") else lindisc(rep, e, t)
    rooted = kind in ("mmd_rbf", "mmd_lin")
    return Imbalance(T.safe_sqrt(distance * r_alpha**2) if rooted else distance * r_alpha, distance)


def compute_imbalance(rep: Tensor, t: np.ndarray, kind: str = "mmd2_lin", e: np.ndarray | None = None, **options) -> Tensor:
    """The loss term of ``imbalance`` alone."""
    return imbalance(rep, t, kind, e, **options).loss


SMOOTH = 0.01  # where smooth_l1 turns from squares to absolute values


@dataclass
class CFRLoss(Loss):
    """Weighted factual loss plus an imbalance penalty on the representation and a penalty on squared weights.

    ``use_p_correction``: the imbalance is weighed by the propensities, else by one half.  ``rep_weight_decay``: the
    penalty on weights covers the representation (names that start with ``rep``) too, else the heads alone.
    """

    loss_type: str = "mse"
    reweight_sample: bool = False
    p_alpha: float = 0.0
    p_lambda: float = 0.0
    rep_weight_decay: bool = False
    use_p_correction: bool = False
    imb_fun: str = "mmd2_lin"
    r_alpha: float = 1.0
    r_lambda: float = 1.0
    rbf_sigma: float = 0.1
    wass_lambda: float = 10.0
    wass_iterations: int = 50

    def __call__(self, y0, y1, t, y, rep=None, weights=(), rep_weights=(), propensity=None, **extra):
        p = chosen(y0, y1, t)
        e = np.clip(propensity if propensity is not None else np.full_like(t, t.mean()), 1e-3, 1 - 1e-3)
        w = t / (2 * e) + (1 - t) / (2 * (1 - e)) if self.reweight_sample else np.ones_like(t)
        gap = p - y
        if self.loss_type == "mse":
            each = T.square(gap)
        elif self.loss_type == "l1":
            each = T.absolute(gap)
        elif self.loss_type == "log":
            q = T.clip(T.sigmoid(p), 0.0025, 0.9975)
            each = -(T.log(q) * y + T.log(1 - q) * (1 - y))
        elif self.loss_type == "smooth_l1":
            small = (np.abs(gap.data) < SMOOTH).astype(float)
            each = T.square(gap) * (0.5 / SMOOTH) * small + (T.absolute(gap) - 0.5 * SMOOTH) * (1 - small)
        else:
            raise ValueError(f"unknown loss_type {self.loss_type!r}")
        loss = (each * w).mean()
        if self.p_alpha and rep is not None:
            loss = loss + compute_imbalance(rep, t, self.imb_fun, e if self.use_p_correction else None, sigma=self.rbf_sigma, lam=self.wass_lambda, its=self.wass_iterations, r_alpha=self.r_alpha) * self.p_alpha
        if self.p_lambda:
            for weight in (*weights, *(rep_weights if self.rep_weight_decay else ())):
                loss = loss + T.square(weight).sum() * (self.p_lambda * self.r_lambda)
        return loss
