"""Parameters of the build and the retrieval, as frozen dataclasses. Defaults are fixed values of the method."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Embedding:
    """backend: 'hashing', or the name under which a model function was registered."""

    backend: str = "hashing"
    dim: int = 384
    normalize: bool = True


@dataclass(frozen=True)
class Matching:
    detection_score_threshold: float = 0.0
    iou_weight: float = 0.60
    combined_threshold: float = 0.40
    label_threshold: float = 0.35
    min_iou_threshold: float = 0.01
    movement_event_threshold: float = 10.0
    miss_tolerance: int = 0
    relation_semantic_threshold: float = 0.85
    attribute_semantic_threshold: float = 0.85
    relation_removal_debounce: int = 3
    attribute_removal_debounce: int = 3


@dataclass(frozen=True)
class Trajectory:
    movement_threshold: float = 10.0
    static_threshold: float = 15.0
    jump_vertical_threshold: float = 25.0
    min_frames_for_summary: int = 2


@dataclass(frozen=True)
class Motion:
    approach_distance_ratio: float = 0.70
    depart_distance_ratio: float = 1.43
    moving_together_angle_deg: float = 30.0
    direction_change_angle_deg: float = 45.0
    min_interaction_distance: float = 5.0


@dataclass(frozen=True)
class Search:
    top_k: int = 8
    similarity_threshold: float = 0.15
    entity_top_k: int = 4
    rerank_entity_bonus: float = 0.12
    rerank_relation_bonus: float = 0.10
    rerank_temporal_bonus: float = 0.08
    rerank_intent_bonus: float = 0.12


#: Kinds of graph nodes that can be switched off; entity_state always exists.
NODE_KINDS = ("entity_appeared", "entity_moved", "relation", "layer_map", "attribute_changed", "interaction", "occlusion", "entity_disappeared", "periodic_description")


@dataclass(frozen=True)
class Dag:
    """kinds: node kinds to make. relation_scope: 'call' ends a relation that the next subject's list lacks, 'frame' one that the next frame lacks.
    compat: leave out the kinds that the plain build path never makes (attribute_changed, interaction, layer_map)."""

    kinds: frozenset = frozenset(NODE_KINDS)
    relation_scope: str = "call"
    compat: bool = True
    movement_threshold: float = 10.0
    relation_debounce_frames: int = 3
    closure_max_depth: int = 10
    closure_top_k_seeds: int = 5
    transitive_reduction: bool = True


@dataclass(frozen=True)
class Config:
    embedding: Embedding = field(default_factory=Embedding)
    matching: Matching = field(default_factory=Matching)
    trajectory: Trajectory = field(default_factory=Trajectory)
    motion: Motion = field(default_factory=Motion)
    search: Search = field(default_factory=Search)
    dag: Dag = field(default_factory=Dag)
    buffer_size: int = 5
    clear_existing_sample: bool = True
