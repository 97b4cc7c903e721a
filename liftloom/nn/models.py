"""Architectures: parameters are arrays by name, ``forward`` builds outputs from tensors of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import losses as L
from . import tape as T
from .tape import Tensor


@dataclass
class Net:
    """Settings of all architectures; two arms unless ``n_treatments`` is larger and the class allows it."""

    input_size: int
    hidden_size: int = 32
    activation: str = "ELU"
    rep_n_layers: int = 2
    head_n_layers: int = 2
    n_treatments: int = 2
    loss: L.Loss | None = None
    multi_arm = False
    dose = False

    def __post_init__(self):
        if self.n_treatments > 2 and not self.multi_arm:
            raise ValueError(f"{type(self).__name__} takes one treated arm")
        self.loss = self.loss or self.default_loss()

    def default_loss(self) -> L.Loss:
        return L.MSELoss()

    @property
    def arms(self) -> range:
        return range(self.n_treatments)

    # -- blocks

    def dense(self, p: dict, rng, name: str, sizes: list[int], scale: float = 1.0) -> None:
        for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
            p[f"{name}.w{i}"] = rng.normal(0, scale * np.sqrt(2 / (a + b)), (a, b))
            p[f"{name}.b{i}"] = np.zeros((1, b))

    def run(self, p: dict[str, Tensor], name: str, x: Tensor, last: bool = True) -> Tensor:
        """A dense stack; ``last``: with activation after the last layer too."""
        n = sum(k.startswith(f"{name}.w") for k in p)
        act = T.activation(self.activation)
        for i in range(n):
            x = x @ p[f"{name}.w{i}"] + p[f"{name}.b{i}"]
            if last or i < n - 1:
                x = act(x)
        return x

    def body(self, p, rng, name: str, inputs: int, layers: int | None = None) -> None:
        self.dense(p, rng, name, [inputs, *[self.hidden_size] * (layers or self.rep_n_layers)])

    def head(self, p, rng, name: str, inputs: int, outputs: int | None = None) -> None:
        width = max(2, self.hidden_size // 2)
        self.dense(p, rng, name, [inputs, *[width] * (self.head_n_layers - 1), outputs or self.loss.outputs])

    # -- to be given

    def init(self, rng) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def forward(self, p: dict[str, Tensor], x: Tensor, t: np.ndarray | None = None) -> dict:
        """``y``: a head per arm; further entries go to the loss."""
        raise NotImplementedError

    def objective(self, p: dict[str, Tensor], x: np.ndarray, t: np.ndarray, y: np.ndarray) -> Tensor:
        out = self.forward(p, Tensor(x), t)
        heads = out.pop("y")
        if len(heads) > 2:
            own = sum(((t == a).astype(float) * h for a, h in enumerate(heads)), Tensor(np.zeros_like(y)))
            return T.square(own - y).mean() + out.get("penalty", Tensor(0.0))
        penalty = out.pop("penalty", None)
        loss = self.loss(heads[0], heads[1], t, y, weights=[w for k, w in p.items() if ".w" in k and not k.startswith("rep")], rep_weights=[w for k, w in p.items() if ".w" in k and k.startswith("rep")], **out)
        return loss if penalty is None else loss + penalty

    def outcomes(self, p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        """[n, arms] predicted outcomes."""
        heads = self.forward({k: Tensor(v) for k, v in p.items()}, Tensor(x))["y"]
        decode = self.loss.decode if len(heads) == 2 else L.Loss().decode
        return np.column_stack([decode(h.data) for h in heads])


def additive(base: Tensor, effects: list[Tensor]) -> list[Tensor]:
    return [base, *(base + e for e in effects)]


@dataclass
class TARNet(Net):
    """A shared representation with a head per arm (effects added to the control's with several arms)."""

    multi_arm = True

    def init(self, rng):
        p: dict = {}
        self.body(p, rng, "rep", self.input_size)
        for a in self.arms:
            self.head(p, rng, f"head{a}", self.hidden_size)
        return p

    def represent(self, p, x, training):
        return self.run(p, "rep", x)

    def forward(self, p, x, t=None):
        rep = self.represent(p, x, t is not None)
        heads = [self.run(p, f"head{a}", rep, False) for a in self.arms]
        return {"y": heads if self.n_treatments == 2 else additive(heads[0], heads[1:]), "rep": rep}


MOMENTUM = 0.1  # share of a batch in the running statistics of batch normalisation


@dataclass
class CFRNet(TARNet):
    """TARNet with balanced representations; optional feature weights, normalisation and a joint head.

    Batch normalisation uses the batch in training and the running statistics at prediction.
    """

    varsel: bool = False
    split_output: bool = True
    normalization: str = "none"
    batch_norm: bool = False

    def default_loss(self):
        return L.CFRLoss(p_alpha=1.0)

    def init(self, rng):
        p = super().init(rng)
        if self.varsel:
            p["select"] = np.full((1, self.input_size), 1.0 / self.input_size)
        if not self.split_output:
            self.head(p, rng, "joint", self.hidden_size + 1)
        if self.normed:
            p |= {"norm.mean": np.zeros((1, self.hidden_size)), "norm.var": np.ones((1, self.hidden_size))}
        return p

    @property
    def normed(self) -> bool:
        return self.batch_norm or self.normalization in ("bn", "bn_fixed")

    def represent(self, p, x, training):
        rep = self.run(p, "rep", x * p["select"] if self.varsel else x)
        if self.normed:
            mean, spread = p["norm.mean"].data, p["norm.var"].data
            if training and rep.shape[0] > 1:
                centred = rep - rep.mean(0, True)
                square = T.square(centred).mean(0, True)
                n = rep.shape[0]
                # kept with the weights, in place, and averaged like them
                mean += MOMENTUM * (rep.data.mean(0, keepdims=True) - mean)
                spread += MOMENTUM * (square.data * n / (n - 1) - spread)
                rep = centred / T.safe_sqrt(square + 1e-5)
            else:
                rep = (rep - mean) / np.sqrt(spread + 1e-5)
        if self.normalization == "divide":
            rep = rep / T.safe_sqrt(T.square(rep).sum(1, True))
        elif self.normalization not in ("none", "bn", "bn_fixed"):
            raise ValueError(f"unknown normalization {self.normalization!r}")
        return rep

    def forward(self, p, x, t=None):
        if self.split_output or self.n_treatments > 2:
            out = super().forward(p, x, t)
        else:
            rep = self.represent(p, x, t is not None)
            one = np.ones((x.shape[0], 1))
            out = {"y": [self.run(p, "joint", T.concat([rep, one * a]), False) for a in (0, 1)], "rep": rep}
        if self.n_treatments > 2 and t is not None and self.loss.p_alpha:
            out["penalty"] = sum((L.compute_imbalance(out["rep"][np.flatnonzero((t[:, 0] == 0) | (t[:, 0] == a))], (t[(t[:, 0] == 0) | (t[:, 0] == a)] == a).astype(float), self.loss.imb_fun) for a in self.arms[1:]), Tensor(0.0)) * self.loss.p_alpha
        return out


@dataclass
class DragonNet(TARNet):
    """TARNet with a propensity head on the representation."""

    def default_loss(self):
        return L.DragonNetLoss() if self.n_treatments == 2 else L.MSELoss()

    def init(self, rng):
        p = super().init(rng)
        self.dense(p, rng, "propensity", [self.hidden_size, 1 if self.n_treatments == 2 else self.n_treatments])
        p["epsilon"] = np.zeros((1, 1))
        return p

    def forward(self, p, x, t=None):
        out = super().forward(p, x, t)
        logit = self.run(p, "propensity", out["rep"], False)
        if self.n_treatments == 2:
            return out | {"logit": logit, "epsilon": p["epsilon"]}
        if t is not None:
            own = (t == np.arange(self.n_treatments)[None, :]).astype(float)
            out["penalty"] = -(T.log_softmax(logit) * own).sum(1).mean()
        return out


@dataclass
class DESCN(Net):
    """Heads that see the representation and the estimated propensity."""

    propensity_weight: float = 1.0

    def init(self, rng):
        p: dict = {}
        self.body(p, rng, "rep", self.input_size)
        self.dense(p, rng, "propensity", [self.hidden_size, 1])
        for a in self.arms:
            self.head(p, rng, f"head{a}", self.hidden_size + 1)
        return p

    def forward(self, p, x, t=None):
        rep = self.run(p, "rep", x)
        logit = self.run(p, "propensity", rep, False)
        seen = T.concat([rep, T.sigmoid(logit)])
        out = {"y": [self.run(p, f"head{a}", seen, False) for a in self.arms], "rep": rep}
        if t is not None:
            out["penalty"] = T.bce(logit, t).mean() * self.propensity_weight
        return out


@dataclass
class EFIN(Net):
    """The effect reads a representation gated by a learned interaction with the treatment."""

    interaction_weight: float = 1.0

    def init(self, rng):
        p: dict = {}
        self.body(p, rng, "rep", self.input_size)
        self.dense(p, rng, "gate", [self.hidden_size, self.hidden_size])
        self.dense(p, rng, "guess", [self.hidden_size, 1])
        for name in ("control", "effect"):
            self.head(p, rng, name, self.hidden_size)
        return p

    def forward(self, p, x, t=None):
        rep = self.run(p, "rep", x)
        gated = rep * T.sigmoid(self.run(p, "gate", rep, False))
        y0 = self.run(p, "control", rep, False)
        out = {"y": [y0, y0 + self.run(p, "effect", gated, False)], "rep": rep}
        if t is not None:
            out["penalty"] = T.bce(self.run(p, "guess", gated, False), t).mean() * self.interaction_weight
        return out


@dataclass
class EUEN(Net):
    """Separate towers for the control outcome and the effect."""

    def init(self, rng):
        p: dict = {}
        for name in ("control", "effect"):
            self.body(p, rng, f"{name}_rep", self.input_size)
            self.head(p, rng, name, self.hidden_size)
        return p

    def forward(self, p, x, t=None):
        y0, tau = (self.run(p, n, self.run(p, f"{n}_rep", x), False) for n in ("control", "effect"))
        return {"y": [y0, y0 + tau]}


@dataclass
class FlexTENet(Net):
    """Shared and private subspaces kept apart by an orthogonality penalty."""

    shared_ratio: float = 0.5
    ortho_lambda: float = 1e-3

    def init(self, rng):
        p: dict = {}
        shared = max(1, int(self.hidden_size * self.shared_ratio))
        private = max(1, self.hidden_size - shared)
        self.dense(p, rng, "shared", [self.input_size, *[shared] * self.rep_n_layers])
        for a in self.arms:
            self.dense(p, rng, f"private{a}", [self.input_size, *[private] * self.rep_n_layers])
            self.head(p, rng, f"head{a}", shared + private)
        return p

    def forward(self, p, x, t=None):
        shared = self.run(p, "shared", x)
        heads = [self.run(p, f"head{a}", T.concat([shared, self.run(p, f"private{a}", x)]), False) for a in self.arms]
        ortho = sum((T.square(p["shared.w0"].T @ p[f"private{a}.w0"]).sum() for a in self.arms), Tensor(0.0))
        return {"y": heads, "penalty": ortho * self.ortho_lambda}


@dataclass
class M3TN(Net):
    """A mixture of experts with a gate per arm and additive heads."""

    n_experts: int = 4
    multi_arm = True

    def init(self, rng):
        p: dict = {}
        for k in range(self.n_experts):
            self.body(p, rng, f"expert{k}_", self.input_size)
        for a in self.arms:
            self.dense(p, rng, f"gate{a}", [self.input_size, self.n_experts])
            self.head(p, rng, f"head{a}", self.hidden_size, 1)
        return p

    def forward(self, p, x, t=None):
        experts = [self.run(p, f"expert{k}_", x) for k in range(self.n_experts)]
        heads = []
        for a in self.arms:
            gate = T.softmax(self.run(p, f"gate{a}", x, False))
            mixed = sum((e * gate[:, k : k + 1] for k, e in enumerate(experts)), Tensor(np.zeros((1, 1))))
            heads.append(self.run(p, f"head{a}", mixed, False))
        return {"y": additive(heads[0], heads[1:])}

    def objective(self, p, x, t, y):
        heads = self.forward(p, Tensor(x))["y"]
        own = sum(((t == a).astype(float) * h for a, h in enumerate(heads)), Tensor(np.zeros_like(y)))
        return T.square(own - y).mean()


@dataclass
class DoseNet(Net):
    """Models of a dose in [0, 1]: factual squared error; effects compare ``target_dose`` with ``reference_dose``."""

    reference_dose: float = 0.0
    target_dose: float = 1.0
    dose = True

    def response(self, p: dict[str, Tensor], x: Tensor, dose: np.ndarray) -> Tensor:
        raise NotImplementedError

    def objective(self, p, x, t, y):
        return T.square(self.response(p, Tensor(x), np.clip(t, 0, 1)) - y).mean()

    def forward(self, p, x, t=None):
        full = lambda d: np.full((x.shape[0], 1), float(d))
        return {"y": [self.response(p, x, full(self.reference_dose)), self.response(p, x, full(self.target_dose))]}

    def dose_response(self, p: dict[str, np.ndarray], x: np.ndarray, grid: list[float]) -> np.ndarray:
        """[n, grid] predicted outcomes."""
        p = {k: Tensor(v) for k, v in p.items()}
        return np.column_stack([self.response(p, Tensor(x), np.full((len(x), 1), float(g))).data[:, 0] for g in grid])


@dataclass
class VCNet(DoseNet):
    """Head weights that vary with the dose along a truncated power basis."""

    n_knots: int = 2
    spline_degree: int = 2

    def basis(self, t: np.ndarray) -> np.ndarray:
        knots = np.linspace(0, 1, self.n_knots + 2)[1:-1]
        return np.hstack([t**d for d in range(self.spline_degree + 1)] + [np.maximum(t - k, 0) ** self.spline_degree for k in knots])

    def init(self, rng):
        p: dict = {}
        self.body(p, rng, "rep", self.input_size)
        for b in range(self.spline_degree + 1 + self.n_knots):
            self.dense(p, rng, f"vary{b}", [self.hidden_size, 1])
        return p

    def response(self, p, x, dose):
        rep, basis = self.run(p, "rep", x), self.basis(dose)
        return sum((self.run(p, f"vary{b}", rep, False) * basis[:, b : b + 1] for b in range(basis.shape[1])), Tensor(np.zeros((1, 1))))


@dataclass
class DRNet(DoseNet):
    """A head per stratum of the dose, each also reading the dose."""

    n_strata: int = 5

    def init(self, rng):
        p: dict = {}
        self.body(p, rng, "rep", self.input_size)
        for s in range(self.n_strata):
            self.head(p, rng, f"head{s}_", self.hidden_size + 1, 1)
        return p

    def response(self, p, x, dose):
        rep = T.concat([self.run(p, "rep", x), dose])
        stratum = np.floor(np.minimum(np.maximum(dose, 0), 1 - 1e-6) * self.n_strata)
        return sum((self.run(p, f"head{s}_", rep, False) * (stratum == s) for s in range(self.n_strata)), Tensor(np.zeros((1, 1))))


@dataclass
class TwoStageUplift(TARNet):
    """TARNet with conversion and value outputs."""

    multi_arm = False

    def default_loss(self):
        return L.TwoStageLoss()


MODELS = {c.__name__: c for c in (TARNet, CFRNet, DragonNet, DESCN, EFIN, EUEN, FlexTENet, M3TN, VCNet, DRNet, TwoStageUplift)}


def with_rerum(net: Net, **weights) -> Net:
    """The same architecture under the ranking loss of value models (three outputs per head)."""
    if net.dose or net.n_treatments > 2 or isinstance(net, M3TN):
        raise TypeError("the ranking loss needs a model of two arms whose heads follow the loss")
    settings = {k: v for k, v in vars(net).items() if k != "loss"}
    if isinstance(net, CFRNet) and isinstance(net.loss, L.CFRLoss):
        weights = {"imbalance": net.loss.imb_fun, "p_alpha": net.loss.p_alpha} | weights
    return type(net)(**settings, loss=L.RERUMLoss(**weights))


