"""Pipelines as data: one preset names the parts of a schedule and their parameters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class GraphConfig:
    enabled: bool = False
    depth: int = 1
    source_topk: int = 3
    full_cover: int = 0
    quota_mode: str = "soft_bias"
    tau: float = 0.5
    lam: float = 0.7
    mu: float = 0.2
    min_quota: int = 1
    rel_var_threshold: float = 0.02
    semantic_source_topk: int = 0
    strength_weights: dict = field(default_factory=lambda: {"topic": 1.0})
    strength_alpha: float = 0.5
    fallback_all: bool = True
    include_self: bool = False


@dataclass(frozen=True)
class SchedulingConfig:
    retriever: str = "bm25"
    attention: str = "full"
    weight: str = "full"
    selector: str = "full"
    reward: str = "explicit"
    threshold: float = 0.6
    max_shared: int = 10
    top_k: int = 5
    candidates: int = 50
    enabled_dims: tuple = ()
    task_filter: bool = True
    version_filter: bool = True
    version_cos: float = 0.9
    tier: str = "fast"
    llm_calls: int = 1
    graph: GraphConfig = field(default_factory=GraphConfig)
    semantic_floor: float = 0.5
    parity: bool = False


def _graph(topk: int, mode: str, **more) -> GraphConfig:
    return GraphConfig(enabled=True, source_topk=topk, quota_mode=mode, **more)


def presets() -> dict[str, SchedulingConfig]:
    """Every named preset, derived from a few families by what each changes."""
    flat = SchedulingConfig(retriever="bm25", attention="noop", weight="uniform", selector="topk", reward="none")
    out = {
        "baseline_naive": replace(flat, retriever="full"),
        "baseline_reme": replace(flat, retriever="reme"),
        "+attention": replace(flat, attention="full"),
        "+weight": replace(flat, attention="full", weight="full"),
        "full_ours": SchedulingConfig(retriever="vector"),
    }
    top8 = SchedulingConfig(retriever="vector", selector="topk", top_k=8, threshold=0.0, tier="full")
    plain = replace(top8, attention="noop", weight="uniform", reward="none", threshold=0.6, tier="fast")
    out["graph_g0"] = replace(plain, graph=_graph(0, "none"))
    out["graph_g1"] = replace(plain, graph=_graph(0, "uniform"))
    out["graph_g2"] = replace(top8, graph=_graph(1, "none"))
    out["graph_g3"] = replace(top8, graph=_graph(3, "uniform"))
    g4 = out["graph_g4"] = replace(top8, graph=_graph(3, "strength"))
    b = replace(g4, selector="full", top_k=5)
    out |= {
        "graph_b0": b, "graph_b1": replace(b, llm_calls=0), "graph_b2": replace(b, candidates=20),
        "graph_b3": replace(b, graph=_graph(3, "strength", lam=1.0)), "graph_b4": replace(b, tier="balanced"),
    }
    with_graph = lambda c=g4, **kw: replace(c, graph=replace(c.graph, **kw))
    out |= {
        "graph_g4_norm": replace(g4, attention="normalized"), "graph_g4_adt": replace(g4, attention="adaptive_time"), "graph_g4_adt_gate": replace(g4, attention="adaptive_gated"),
        "graph_g4_t08": with_graph(tau=0.08), "graph_g4_t15": with_graph(tau=0.15), "graph_g4_t25": with_graph(tau=0.25), "graph_g4_st8": with_graph(source_topk=8), "graph_g4_uw": g4,
        "graph_g4_lam0": with_graph(lam=0.0), "graph_g4_lam3": with_graph(lam=0.3), "graph_g4_vth0": with_graph(rel_var_threshold=0.0),
        "graph_g4_notime": replace(g4, enabled_dims=("semantic", "frequency", "task"), tier="fast"), "graph_g4_semonly": replace(g4, enabled_dims=("semantic",), tier="fast"),
    }
    casc = replace(with_graph(full_cover=5), selector="cascade")
    out |= {"graph_g4_casc": casc, "graph_g4_c_t": replace(casc, version_filter=False), "graph_g4_c_v": replace(casc, task_filter=False)}
    out |= {f"graph_g4_c_v{n}": replace(casc, version_cos=n / 100) for n in (85, 92, 95)}
    out["graph_g4_q"] = replace(g4, selector="quota")
    qs = out["graph_g4_qs"] = replace(with_graph(full_cover=5), selector="quota")
    out |= {f"graph_g4_qs_m{n}": with_graph(qs, mu=n / 100) for n in (20, 40, 60, 100)}
    used = {"topic": 0.6, "interact": 0.8}
    out |= {f"graph_g4_qs_a{a}": with_graph(qs, strength_weights=used, strength_alpha=a) for a in (0.3, 0.7, 1.0)}
    factors = {"mf_i": used, "mf_it": used | {"temporal": 0.3}, "mf_all": used | {"temporal": 0.3, "struct": 0.3}, "w": {"topic": 1.0}}
    out |= {f"graph_g4_qs_{n}": with_graph(qs, strength_weights=w) for n, w in factors.items()}
    out |= {"graph_g4_qs_nt": replace(qs, enabled_dims=("semantic", "frequency", "task")), "graph_g4_qs_ntf": replace(qs, enabled_dims=("semantic", "task"))}
    sem = out["graph_g4_sem5"] = with_graph(semantic_source_topk=5)
    out |= {"graph_g4_sem5_t5": with_graph(sem, source_topk=5), "graph_g4_sem5_vth0": with_graph(sem, rel_var_threshold=0.0)}
    for n, lam in (("0", 0.0), ("3", 0.3)):
        out[f"graph_g4_sem5_lam{n}"] = with_graph(sem, lam=lam)
        out[f"graph_g4_sem5_v0_l{n}"] = out[f"graph_g4_sem5_fl{n}"] = with_graph(sem, lam=lam, rel_var_threshold=0.0)
    out["graph_g2_sem5_fl0"] = with_graph(out["graph_g2"], semantic_source_topk=5, lam=0.0, rel_var_threshold=0.0)
    return out


PRESETS = presets()
