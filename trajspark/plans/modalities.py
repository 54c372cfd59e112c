"""Modality configurations: which offsets and keys a pipeline asks for, checked at plan time."""

from dataclasses import dataclass, field

KINDS = ("video", "state", "action", "language")
ENCODINGS = ("minmax", "meanstd", "sincos")


@dataclass(frozen=True)
class ActionConfig:
    """How an action group is represented: absolute, delta or relative; joint or pose; by which state."""

    representation: str = "absolute"
    kind: str = "joint"
    form: str = "default"
    state_key: str | None = None

    def __post_init__(self):
        if self.representation not in ("absolute", "delta", "relative") or self.kind not in ("joint", "pose") or self.form not in ("default", "rot6d", "rotvec"):
            raise ValueError("unknown action configuration")
        if self.kind == "joint" and self.form != "default":
            raise ValueError("joints have no pose format")

    def reference(self, key: str) -> str:
        """The state group an action is relative to."""
        return self.state_key or key


@dataclass(frozen=True)
class ModalityConfig:
    """Offsets and keys of one modality; actions get the default configuration where none is given."""

    deltas: tuple[int, ...]
    keys: tuple[str, ...]
    sincos: tuple[str, ...] = ()
    meanstd: tuple[str, ...] = ()
    actions: tuple[ActionConfig, ...] = field(default=())

    def __post_init__(self):
        if not self.deltas:
            raise ValueError("at least one offset is needed")
        if self.actions and len(self.actions) != len(self.keys):
            raise ValueError("one action configuration per key is needed")
        if not set(self.sincos) | set(self.meanstd) <= set(self.keys):
            raise ValueError("an encoding names an unknown key")

    def action_of(self, key: str) -> ActionConfig:
        return self.actions[self.keys.index(key)] if self.actions else ActionConfig()

    def mode(self, key: str) -> str:
        return "sincos" if key in self.sincos else "meanstd" if key in self.meanstd else "minmax"

    @property
    def horizon(self) -> int:
        return max(self.deltas) - min(self.deltas) + 1


def checked(configs: dict[str, ModalityConfig]) -> dict[str, ModalityConfig]:
    """Known modalities only; language is reduced to its first key and must be asked for at offset 0."""
    out = {k: v for k, v in configs.items() if k in KINDS}
    if "language" in out:
        c = out["language"]
        if c.deltas != (0,):
            raise ValueError("language has the single offset 0")
        out["language"] = ModalityConfig((0,), c.keys[:1])
    return out


def streaming_deltas(deltas: tuple[int, ...]) -> None:
    """Offsets a stream can serve: none ahead, the last 0, evenly spaced."""
    steps = {b - a for a, b in zip(deltas, deltas[1:])}
    if not deltas or deltas[-1] != 0 or max(deltas) > 0 or len(steps) > 1 or any(s <= 0 for s in steps):
        raise ValueError("offsets must end in 0 and rise evenly")


def matched_video_keys(wanted: list[str], stored: list[str]) -> dict[str, str]:
    """Stored names to wanted names: by name, or by position when none match and there are as many."""
    if set(wanted) <= set(stored):
        return {k: k for k in wanted}
    if len(wanted) == len(stored):
        return dict(zip(stored, wanted))
    raise KeyError(f"videos {wanted} are not stored")


class Registry:
    """Configurations by tag; a tag is registered once."""

    def __init__(self):
        self.configs: dict[str, dict[str, ModalityConfig]] = {}

    def register(self, tag: str, configs: dict[str, ModalityConfig]) -> None:
        if tag in self.configs:
            raise ValueError(f"{tag} is registered")
        self.configs[tag] = checked(configs)

    def __getitem__(self, tag: str) -> dict[str, ModalityConfig]:
        return self.configs[tag]


def mixture(specs: list[dict]) -> list[dict]:
    """Mixture entries {path, tag, ratio}: ratios are positive in sum and scaled to add up to 1; tags are needed."""
    if any(not s.get("tag") for s in specs) or any(s.get("ratio", 1.0) < 0 for s in specs):
        raise ValueError("every entry needs a tag and a ratio of at least 0")
    total = sum(s.get("ratio", 1.0) for s in specs)
    if total <= 0:
        raise ValueError("the ratios must have a positive sum")
    return [s | {"ratio": s.get("ratio", 1.0) / total} for s in specs]
