"""Parameters, with the defaults of the engine's command line."""

from __future__ import annotations

from dataclasses import MISSING, dataclass, field, fields


@dataclass(frozen=True)
class Convert:
    data_in: str
    data_format: str
    data_out: str
    data_out_format: str
    part_size: float = -1  # MB a file; -1: a file a task
    chunk_size: float = 512


@dataclass(frozen=True)
class SGDLearn:
    data_in: str = ""
    batch_size: int = 10_000  # 0: all rows at once
    data_format: str = "libsvm"
    data_val: str = ""
    model_out: str = ""
    model_in: str = ""
    loss: str = "fm"
    max_num_epochs: int = 20
    num_jobs_per_epoch: int = 10
    shuffle: int = 10
    neg_sampling: float = 1.0
    stop_rel_objv: float = 1e-5
    stop_val_auc: float = 1e-5


@dataclass(frozen=True)
class SGDUpdate:
    l1: float = 1.0
    l2: float = 0.0
    V_l2: float = 0.01
    lr: float = 0.01
    lr_beta: float = 1.0
    V_lr: float = 0.01
    V_lr_beta: float = 1.0
    V_init_scale: float = 0.01
    V_threshold: int = 10
    V_dim: int = 0
    seed: int = 0


@dataclass(frozen=True)
class LBFGSLearn:
    data_in: str = ""
    data_val: str = ""
    data_format: str = "libsvm"
    data_cache: str = ""
    data_chunk_size: int = 256
    loss: str = "fm"
    model_out: str = ""
    model_in: str = ""
    max_num_epochs: int = 100
    min_num_epochs: int = 10
    alpha: float = 1.0
    init_alpha: float = 0.0
    max_num_linesearchs: int = 5
    c1: float = 1e-4
    c2: float = 0.9
    rho: float = 0.5
    gamma: float = 1.0
    load_epoch: int = 0
    stop_rel_objv: float = 1e-5
    stop_val_auc: float = 1e-5
    num_threads: int = 0


@dataclass(frozen=True)
class LBFGSUpdate:
    tail_feature_filter: int = 4
    l2: float = 0.1
    V_l2: float = 0.01
    V_dim: int = 0
    V_threshold: int = 0
    m: int = 10
    V_init_scale: float = 0.01
    seed: int = 0


@dataclass(frozen=True)
class BCDLearn:
    data_in: str = ""
    data_val: str = ""
    data_format: str = "libsvm"
    data_cache: str = ""
    data_chunk_size: int = 1 << 28
    loss: str = "logit_delta"
    model_out: str = ""
    model_in: str = ""
    max_num_epochs: int = 20
    random_block: int = 1
    num_feature_group_bits: int = 0
    block_ratio: float = 4.0
    neg_sampling: float = 1.0
    seed: int = 0


@dataclass(frozen=True)
class BCDUpdate:
    tail_feature_filter: int = 4
    l1: float = 1.0
    l2: float = 0.01  # not used by the update
    lr: float = 0.9


#: Settings that are taken and change nothing, as Spark decides what they decided.
UNUSED = {"data_cache", "data_chunk_size", "chunk_size", "num_threads"}


@dataclass
class Given:
    """Settings as text, taken by one set of parameters after another; left is what none has taken."""

    settings: dict[str, str]
    left: set[str] = field(init=False)

    def __post_init__(self) -> None:
        self.left = set(self.settings)

    def take(self, kind: type):
        values = {}
        for f in fields(kind):
            if f.name in self.settings:
                self.left.discard(f.name)
                values[f.name] = {"int": lambda x: int(float(x)), "float": float, "str": str}[f.type](self.settings[f.name])
            elif f.default is MISSING:
                raise ValueError(f"{f.name} must be given")
        return kind(**values)


def parse(words: list[str]) -> dict[str, str]:
    """key=value words; the text of a file given as argfile=path counts as words after the others. The last one for a key wins. Later argfiles are ignored, and so are a file's own."""
    own = [w for w in words if not w.startswith("argfile=")]
    files = [w.partition("=")[2] for w in words if w.startswith("argfile=")]
    if files:
        with open(files[0]) as f:
            own += [w for line in f for w in line.split("#")[0].replace(" = ", "=").split() if not w.startswith("argfile=")]
    out: dict[str, str] = {}
    for w in own:
        key, eq, value = w.partition("=")
        if not eq or not key:
            raise ValueError(f"not key=value: {w}")
        out[key] = value
    return out
