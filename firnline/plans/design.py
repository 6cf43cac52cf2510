"""Design rows of the regressions, as Spark columns and as arrays from one definition."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from firnline.schema import FEATURES, TARGET, THICKNESS

_MODELS: dict[str, Callable] = {}


def register_model(name: str):
    def add(fn):
        if name in _MODELS:
            raise ValueError(f"model {name!r} is already registered")
        _MODELS[name] = fn
        return fn
    return add


def get_model(name: str) -> Callable:
    if name not in _MODELS:
        raise KeyError(f"unknown model {name!r}; known: {list_models()}")
    return _MODELS[name]


def list_models() -> list[str]:
    return sorted(_MODELS)


@register_model("linear")
def linear_terms(cols: dict, one) -> dict:
    """alpha + beta . X"""
    return {"alpha": one, **{f"beta[{n}]": v for n, v in cols.items()}}


@register_model("atten_refl")
def attenuation_terms(cols: dict, one) -> dict:
    """(alpha_a + beta_a . c) * T - (alpha_r + beta_r . c): linear in its parameters."""
    if THICKNESS not in cols:
        raise ValueError(f"atten_refl needs {THICKNESS}")
    t = cols[THICKNESS]
    cov = {n: v for n, v in cols.items() if n != THICKNESS}
    return {
        "alpha_atten": t * one, **{f"beta_atten[{n}]": t * v for n, v in cov.items()},
        "alpha_refl": -one, **{f"beta_refl[{n}]": -v for n, v in cov.items()},
    }


@dataclass(frozen=True)
class Design:
    """Feature set of a fit: z-scored features, raw indicators, indicator-by-feature products."""

    model: str = "linear"
    features: tuple[str, ...] = tuple(FEATURES)
    indicators: tuple[str, ...] = ("is_greenland", "is_floating")
    interactions: tuple[str, ...] = ()
    target: str = TARGET

    def __post_init__(self):
        stray = [i for i in self.interactions if i not in self.indicators]
        if stray:
            raise ValueError(f"interactions {stray} are not indicators")
        get_model(self.model)

    def interaction_names(self) -> list[str]:
        return [f"{i}_x_{f}" for i in self.interactions for f in self.features if f != THICKNESS]

    def names(self) -> list[str]:
        return [*self.features, *self.indicators, *self.interaction_names()]

    def columns(self, get, norm: dict) -> dict:
        """Name -> value, where ``get(name)`` gives a raw column (Spark or array)."""
        z = {f: (get(f) - norm[f][0]) / norm[f][1] for f in self.features}
        ind = {i: get(i) for i in self.indicators}
        out = {**z, **ind}
        for i in self.interactions:
            for f in self.features:
                if f != THICKNESS:
                    out[f"{i}_x_{f}"] = ind[i] * z[f]
        return out

    def terms(self, get, norm: dict, one) -> dict:
        return get_model(self.model)(self.columns(get, norm), one)

    def term_names(self) -> list[str]:
        norm = {f: (0.0, 1.0) for f in self.features}
        return list(self.terms(lambda n: 1.0, norm, 1.0))

    def raw_columns(self) -> Sequence[str]:
        return [*self.features, *self.indicators]
