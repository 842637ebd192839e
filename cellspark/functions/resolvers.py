"""What a run's configuration leaves open, worked out from the rest: liftings, metrics, widths of features."""

from __future__ import annotations

from ..operators.complex import route

#: Pairs of domains between which a default lifting turns data into another kind.
LIFTED = ("graph2cell", "graph2simplicial", "graph2combinatorial", "graph2hypergraph", "pointcloud2simplicial", "pointcloud2combinatorial", "pointcloud2hypergraph", "pointcloud2cell", "pointcloud2graph", "hypergraph2combinatorial")


def required_lifting(data_domain: str, model: str) -> str:
    """`no_lifting`, or the default lifting from the data's domain to that of a model named domain/name."""
    domain = model.split("/")[0]
    return "no_lifting" if domain == data_domain else f"{data_domain}2{domain}_default"


def default_transform(dataset: str, model: str, datasets: set[str] = frozenset(), models: set[str] = frozenset()) -> str:
    """The configuration for a dataset and a model, each named domain/name, given those that have defaults of their own."""
    (data_domain, data), (model_domain, name) = dataset.split("/"), model.split("/")
    if data in datasets and name in models:
        return f"dataset_model_defaults/{data}_{name}"
    if data in datasets:
        return f"dataset_defaults/{data}"
    if name in models:
        return f"model_defaults/{name}"
    return "no_transform" if data_domain == model_domain else f"liftings/{data_domain}2{model_domain}_default"


def monitored(task: str, metric: str) -> tuple[str, str]:
    """The name of the metric that training watches, and whether its greatest or least value counts."""
    modes = {"classification": "max", "multilabel classification": "max", "regression": "min"}
    if task not in modes:
        raise ValueError(f"no such task: {task}")
    return f"val/{metric}", modes[task]


def default_metrics(task: str, metrics: list[str] | None = None) -> list[str]:
    if metrics is not None:
        return metrics
    if "classification" in task:
        return ["accuracy", "precision", "recall", "auroc"]
    if "regression" in task:
        return ["mse", "mae"]
    raise ValueError(f"no such task: {task}")


def encoding_width(name: str, parameters: dict) -> int:
    """How many features an encoding adds to each node."""
    if name not in ("LapPE", "RWSE"):
        return 0
    return parameters["max_pe_dim"] * (2 if name == "LapPE" and parameters.get("include_eigenvalues") else 1)


def added_features(transforms: dict | None) -> int:
    """How many features the encodings among the transforms add."""
    total = 0
    for key, config in ({"": transforms} if transforms and "transform_name" in transforms else transforms or {}).items():
        if not isinstance(config, dict):
            continue
        name = config.get("transform_name", key)
        if "CombinedPSEs" in name or "encodings" in config:
            total += sum(encoding_width(e, config["parameters"][e]) for e in config.get("encodings", []))
        else:
            total += encoding_width(next((n for n in ("LapPE", "RWSE") if n in name), name), config)
    return total


def in_channels(features: int | list[int], transforms: dict | None, same_domain: bool = False) -> list[int]:
    """The width of the features of each rank after the transforms: one rank without a lifting; with one, as many as its
    complex_dim, all alike, or growing rank by rank where boundaries are concatenated; edge features keep their own."""
    more = added_features(transforms)
    width = [features + more] if isinstance(features, int) else [features[0] + more, *features[1:]]
    lifting = next((c for k, c in (transforms or {}).items() if k.removesuffix("_lifting") in LIFTED), None)
    if lifting is None:
        return width if same_domain and not isinstance(features, int) else width[:1]
    dim = lifting["complex_dim"]
    if len(width) > 1 and lifting.get("preserve_edge_attr"):
        return width + width[1:2] * (dim - len(width))
    out = width[:1]
    for rank in range(2, dim + 1):
        out.append(out[-1] * rank if lifting.get("feature_lifting") == "Concatenation" else out[0])
    return out


def cell_dimensions(selected: list[int] | None, channels: list[int]) -> int:
    return len(channels if selected is None else selected)


def neighbourhood_dimensions(neighborhoods: list[str]) -> int:
    """One more than the greatest rank that a route touches."""
    return max(max(route(n)) for n in neighborhoods) + 1


def flattened_channels(nodes: int, channels: int) -> int:
    return nodes * channels
