"""Data model: schemas of tables, and the parameters of runs."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RECIPE = (
    "speech_index bigint, room string, receiver string, speech_rir_index bigint, noise_indices array<bigint>, "
    "noise_rir_indices array<bigint>, offsets_ms array<double>, number_of_noises int, target_snr_db double, pink_db double, rng_seed bigint"
)
METADATA = (
    "struct<sr:int,target_snr_db:double,pink_db:double,rng_seed:bigint,final_snr_db:double,speech_drr_db:double,"
    "noises:array<struct<drr_db:double,offset_ms:double>>,clipping_scale:double,clipped:boolean>"
)
SCENE = f"scene_id bigint, audio array<double>, text string, is_clean boolean, metadata {METADATA}"
#: Impulse responses as they are ingested; distances and averages are FLOAT.
RIR = "audio struct<bytes:binary,path:string>, Room string, `Room Description` string, `Receiver Label` string, `Direct Path Length [m]` float, `Avg C50` float, `Avg T30` float"

#: The two sets of rooms.
ROOM_SETS = {"A": ("Room9", "Room8", "Room2", "Room4", "Room5"), "B": ("Room10", "Room7", "Room1", "Room3", "Room6")}
#: Fold: (set for training, set for validation).
FOLDS = {1: ("A", "B"), 2: ("B", "A")}


def room_sets(spark: SparkSession) -> DataFrame:
    """(room, room_set): ten rows."""
    return spark.createDataFrame([(room, name) for name, rooms in ROOM_SETS.items() for room in rooms], "room string, room_set string")


def fold_rooms(fold: int) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Rooms for training and for validation."""
    if fold not in FOLDS:
        raise ValueError(f"no fold {fold}")
    train, validation = FOLDS[fold]
    return ROOM_SETS[train], ROOM_SETS[validation]


@dataclass(frozen=True)
class Params:
    """Defaults of scenes and evaluations."""

    sample_rate: int = 16_000
    number_of_noises: int = 2
    clean_probability: float = 0.25
    base_seed: int = 42
    snr_range: tuple[float, float] = (-2.0, 24.0)
    offset_range_ms: tuple[float, float] = (0.0, 3000.0)
    pink_range_db: tuple[float, float] = (35.0, 55.0)
    min_seconds: float = 2.0
    validation_examples: int = 256
    validation_seed: int = 43
    samples_per_band: int = 2000
    samples_per_bin: int = 250
    max_attempts: int = 20
    sweep: tuple[float, float, float] = (-8.0, 6.0, 2.0)
    corpora: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("sample_rate", "number_of_noises", "samples_per_band", "samples_per_bin", "max_attempts", "validation_examples"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.clean_probability <= 1:
            raise ValueError("clean_probability must be between 0 and 1")

    @property
    def key(self) -> str:
        """Hash of all parameters; names a cache of rendered scenes."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    @classmethod
    def read(cls, path: str | Path) -> Params:
        """From the tables of a TOML file; keys that aren't parameters are left to their users."""
        with open(path, "rb") as file:
            tables = tomllib.load(file)
        known = {}
        for values in tables.values():
            if isinstance(values, dict):
                known |= {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in cls.__dataclass_fields__}
        return replace(cls(), **known)
