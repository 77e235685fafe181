"""Settings as frozen dataclasses, with presets and JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from ..operators.corrupt import PRESETS as ERROR_PRESETS
from ..operators.corrupt import ErrorSettings


@dataclass(frozen=True)
class TextSettings:
    unicode: bool = True
    width: bool = True
    blanks: bool = True
    keep_marks: bool = True
    limit: int = 128
    least: int = 5


@dataclass(frozen=True)
class LabelSettings:
    most_inserts: int = 3
    enable_insert: bool = True
    enable_delete: bool = True
    align: str = "minimal"


@dataclass(frozen=True)
class FeatureSettings:
    width: int = 128
    full_mask: bool = True
    auxiliary: bool = True
    auxiliary_share: float = 0.15


@dataclass(frozen=True)
class DecisionSettings:
    delete_at: float = 0.5
    insert_at: float = 0.5
    most_inserts: int = 6
    insert_ratio: float = 0.1
    refine: bool = False
    refine_rounds: int = 2
    refine_ratio: float = 0.15
    verify: bool = False
    accept_at: float = 0.5


@dataclass(frozen=True)
class PromptSettings:
    """What a plugged model is told about its soft prompt; the rules here don't depend on it."""

    prompt: bool = True
    lstm: bool = True
    shared: bool = False
    second: bool = True


@dataclass(frozen=True)
class SplitSettings:
    train: float = 0.8
    dev: float = 0.1
    seed: int = 42
    negatives: int = 2


@dataclass(frozen=True)
class Settings:
    text: TextSettings = field(default_factory=TextSettings)
    errors: ErrorSettings = field(default_factory=ErrorSettings)
    labels: LabelSettings = field(default_factory=LabelSettings)
    features: FeatureSettings = field(default_factory=FeatureSettings)
    decisions: DecisionSettings = field(default_factory=DecisionSettings)
    split: SplitSettings = field(default_factory=SplitSettings)
    prompt: PromptSettings = field(default_factory=PromptSettings)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        given = json.loads(text)
        parts = {"text": TextSettings, "errors": ErrorSettings, "labels": LabelSettings, "features": FeatureSettings, "decisions": DecisionSettings, "split": SplitSettings, "prompt": PromptSettings}
        return cls(**{k: parts[k](**v) for k, v in given.items()})

    def with_(self, **changes: dict) -> Settings:
        """Changed fields by part, as errors={"seed": 7}."""
        return replace(self, **{k: replace(getattr(self, k), **v) for k, v in changes.items()})


PRESETS = {
    "default": Settings(),
    **{f"errors_{k}": Settings(errors=v) for k, v in ERROR_PRESETS.items()},
    "sparse_mask": Settings(features=FeatureSettings(full_mask=False)),
    "long_text": Settings(text=TextSettings(limit=512), features=FeatureSettings(width=512)),
    "no_insert": Settings(labels=LabelSettings(enable_insert=False)),
    "no_delete": Settings(labels=LabelSettings(enable_delete=False)),
    "no_gap": Settings(labels=LabelSettings(enable_insert=False, enable_delete=False)),
    "no_aux_mlm": Settings(features=FeatureSettings(auxiliary=False)),
    "with_refinement": Settings(decisions=DecisionSettings(refine=True, refine_rounds=2)),
    "with_verifier": Settings(decisions=DecisionSettings(verify=True)),
    "no_f2": Settings(prompt=PromptSettings(second=False)),
    "no_ptuning": Settings(prompt=PromptSettings(prompt=False)),
    "ptuning_no_lstm": Settings(prompt=PromptSettings(lstm=False)),
    "ptuning_shared": Settings(prompt=PromptSettings(shared=True)),
    "cautious": Settings(decisions=DecisionSettings(delete_at=0.8, insert_at=0.8, most_inserts=3)),
}


def preset(name: str = "default") -> Settings:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name}; known: {', '.join(PRESETS)}")
    return PRESETS[name]
