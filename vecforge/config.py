"""Settings, constants and the error contract of the clustering engine."""

from __future__ import annotations

from dataclasses import dataclass

# Gates, block widths and tolerances that results depend on.
PRUNING_MIN_D = 128
PRUNING_MIN_K = 256
HORIZONTAL_SHARE = 0.75
HORIZONTAL_BLOCK = 64
MIN_PARTIAL_D = 16
CENTROID_BLOCK = 1024
PERTURBATION = 1.0 / 1024
RECALL_PATIENCE = 2
EPSILON_FLAT = 1.5
EPSILON_HIERARCHICAL = 1.1
F32_EPSILON = 1.1920929e-07

#: Bytes up to which a side is broadcast or held by the driver; larger sets are worked on block by block.
BROADCAST_BYTES = 1 << 30


class ClusteringError(ValueError):
    """A broken precondition; the message says which."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ClusteringError(message)


@dataclass(frozen=True)
class FlatConfig:
    """Settings of one-level training."""

    iters: int = 10
    sampling_fraction: float = 0.3
    max_points_per_cluster: int | None = 256  # of a sample; None: the whole share
    seed: int = 42
    use_blas_only: bool = False
    tol: float = 1e-4
    recall_tol: float = 0.005
    recall_neighbours: int = 10  # true neighbours of a query that tracked recall looks for
    explored: float = 0.1  # share of the clusters that a query looks into for them
    early_termination: bool = True
    sample_queries: bool = False
    min_not_pruned_pct: float = 0.03
    max_not_pruned_pct: float = 0.05
    adjustment_factor_for_partial_d: float = 0.20
    unrotate_centroids: bool = True
    verbose: bool = False
    angular: bool = False
    suppress_warnings: bool = False
    data_already_rotated: bool = False
    use_aggressive_split: bool = False
    metric: str = "l2"
    force_pruning: bool = False  # for tests: pruning below its gates
    epsilon: float = EPSILON_FLAT

    def __post_init__(self) -> None:
        require(self.iters > 0, "iters must be positive")
        require(self.sampling_fraction > 0, "sampling_fraction must be positive")
        require(self.sampling_fraction <= 1.0, "sampling_fraction must be <= 1.0")
        require(self.metric == "l2", "only the l2 metric is supported")


@dataclass(frozen=True)
class HierConfig(FlatConfig):
    """Settings of two-level training; small clusters are always pulled towards large ones."""

    sampling_fraction: float = 1.0
    use_aggressive_split: bool = True
    epsilon: float = EPSILON_HIERARCHICAL
    iters_mesoclustering: int = 3
    iters_fineclustering: int = 5
    iters_refinement: int = 0
    max_group_bytes: int = 64 << 20  # meso clusters with more bytes of doubles are trained by distributed iterations

    def __post_init__(self) -> None:
        super().__post_init__()
        require(self.use_aggressive_split, "hierarchical training always balances small clusters")
        require(self.iters_mesoclustering > 0, "iters_mesoclustering must be positive")
        require(self.iters_fineclustering > 0, "iters_fineclustering must be positive")


def check_shape(n_clusters: int, d: int) -> None:
    require(n_clusters > 0, "n_clusters must be positive")
    require(d > 0, "dimensionality must be positive")


def prunes(cfg: FlatConfig, d: int, k: int) -> bool:
    """Exact or pruned assignment: pruning pays from both gates on."""
    return not cfg.use_blas_only and (cfg.force_pruning or (d >= PRUNING_MIN_D and k > PRUNING_MIN_K))
