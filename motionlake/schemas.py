"""Tables, thresholds and vocabularies of the motion-data engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Default thresholds of the plausibility checks. Lengths are shares of the frame's diagonal, speeds are
# diagonals a second.


@dataclass(frozen=True)
class Thresholds:
    kpt_conf: float = 0.5
    jump_speed: float = 3.5
    jump_min_disp: float = 0.10
    bone_stretch_tol: float = 0.40
    bone_ref_pct: float = 90.0
    bone_min_events: int = 2
    bone_min_samples: int = 10
    bone_min_len: float = 0.02
    ground_band: float = 0.035
    ground_pct: float = 90.0
    ground_min_points: int = 5
    skate_max_vy: float = 0.30
    skate_min_vx: float = 0.60
    skate_min_frames: int = 3
    contact_dist: float = 0.06
    carried_min_speed: float = 0.50
    contact_min_frames: int = 4
    fall_vy_ratio: float = 0.6
    persist_gap_s: float = 0.20
    persist_min_gap: int = 3
    persist_reappear_disp: float = 0.12
    float_ground_clearance: float = 0.10
    float_person_dist: float = 0.15
    float_max_speed: float = 0.08
    float_min_s: float = 1.0
    mater_margin_s: float = 0.5
    edge_margin: float = 0.04
    mater_person_dist: float = 0.12
    idswitch_dist: float = 0.10
    idswitch_gap_s: float = 0.3
    levit_clearance: float = 0.05
    levit_min_s: float = 0.8
    levit_max_vy: float = 0.25
    tk_min_speed: float = 0.35
    tk_dist: float = 0.12
    tk_corr: float = 0.85
    tk_min_frames: int = 5
    deform_log_aspect: float = 0.22
    deform_min_events: int = 3
    gate2_min_severity: float = 0.75
    gate2_scale: float = 0.40
    gate2_cap: float = 0.40
    accept_score: float = 0.72
    critical_severity: float = 0.85


# The weight of the worst violation of each type, in the order in which the checks run, and of any other.
WEIGHTS = {
    "trajectory_jump": 0.25,
    "body_deformation": 0.20,
    "foot_skate": 0.15,
    "contact_incoherence": 0.20,
    "object_disappearance": 0.10,
    "gravity_suspicion": 0.10,
    "object_materialization": 0.20,
    "levitation": 0.15,
    "telekinesis_suspicion": 0.15,
    "object_deformation": 0.15,
    "anatomical_anomaly": 0.03,
    "magic_effect": 0.03,
    "object_morphing": 0.03,
    "impossible_gesture": 0.02,
    "scene_inconsistency": 0.02,
    "prompt_mismatch": 0.02,
}
OTHER_WEIGHT = 0.10

# Keypoints of a person (COCO-17) and the bones between them.
L_SHOULDER, R_SHOULDER, L_WRIST, R_WRIST, L_HIP, R_HIP, L_ANKLE, R_ANKLE = 5, 6, 9, 10, 11, 12, 15, 16
BONES = [
    (5, 7, "left upper arm"),
    (7, 9, "left forearm"),
    (6, 8, "right upper arm"),
    (8, 10, "right forearm"),
    (11, 13, "left thigh"),
    (13, 15, "left shin"),
    (12, 14, "right thigh"),
    (14, 16, "right shin"),
    (5, 6, "shoulder girdle"),
    (11, 12, "pelvis"),
]

# Stages of an episode in canonical order with what each depends on.
STAGES = {
    "ingest": [],
    "feasibility_judge": ["ingest"],
    "geometry": ["feasibility_judge"],
    "human_body": ["geometry"],
    "hands": ["human_body"],
    "objects": ["geometry"],
    "contact": ["hands", "objects"],
    "semantics": ["hands", "contact"],
    "retarget": ["human_body", "hands"],
    "physics_validate": ["retarget"],
    "qa": ["physics_validate", "semantics"],
    "package": ["qa"],
}

# Where a sample comes from, how a stage ends, the vocabulary of skills.
SOURCES = ["captured", "estimated", "triangulated", "fused", "synthesized"]
STATUSES = ["success", "failed", "rejected", "skipped"]
VERBS = [
    "reach", "grasp", "release", "lift", "lower", "place", "push", "pull", "slide", "rotate", "open", "close", "pour", "insert", "remove", "press", "wipe", "stir", "cut",
    "fold", "shake", "hand_over", "hold", "walk", "turn", "wave", "point", "gesture", "idle", "trot", "gallop", "jump", "sit", "lie_down", "stand",
]


TABLES = {
    "clips": "episode_id long, fps double, width int, height int, n_frames long",
    "tracks": "episode_id long, is_person boolean, track_id long, label string, frame long, x1 double, y1 double, x2 double, y2 double",
    "kpts": "episode_id long, track_id long, frame long, kpt_idx int, x double, y double, conf double",
    "violations": "episode_id long, type string, severity double, frames array<long>, reason string, is_person boolean, track_id long, label string, gate string",
    "poses": "episode_id long, t double, frame long, m array<double>, conf double, valid boolean, source string",
    "hands": "episode_id long, t double, frame long, hand string, joint_name string, px double, py double, pz double, qw double, qx double, qy double, qz double, conf double, valid boolean, source string, interpolated boolean",
    "contacts": "episode_id long, t double, frame long, hand string, object_id long, contact boolean, distance double, conf double, source string",
    "segments": "episode_id long, start_s double, end_s double, skill string, text string, evidence string",
    "runs": "id long, created_at timestamp, status string, label_status string, review_status string, camera string, zones long, seconds double",
    "manifests": "episode_id long, stage string, status string, input_hash string, config_hash string, output_hash string, metrics map<string,string>",
    "logs": "id long, ts double, level string, agent string, message string, batch_id string, job_id string",
}

#: Columns without which a table breaks its contract.
REQUIRED = {name: [part.split()[0] for part in text.replace("array<", "array<").split(", ")] for name, text in TABLES.items()}
