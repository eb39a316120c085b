"""Options of an alignment run, with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, fields

_FALSE = {"", "0", "false", "none"}


@dataclass(frozen=True)
class AlignOptions:
    """How profiles are normalised, compared, aligned and merged.

    A given gap_open_penalty switches the automatic penalty off. num_threads
    and parallel_load are accepted and have no effect: Spark schedules tasks.
    """

    alignment_type: str = "global"
    score_type: str = "distance_zscore"
    gap_open_penalty: float | None = None
    gap_penalty_a1_a2: tuple[float, float] = (0.5, 0.5)
    gap_penalty_dynamic_bias: bool = True
    normalize: bool = True
    tree_guided: bool = True
    tree_type: str = "NJ"
    distance_base: str = "averaged_value"
    num_seed_seqs: int = 5
    max_cluster_size: int = -1
    num_iter: int = 1
    random_seed: int = 1
    scoring_matrix: str = "BLOSUM62"
    a3m_pairwise: bool = False
    num_threads: int = 4
    parallel_load: bool = True

    def __post_init__(self):
        self._one_of("alignment_type", "global", "local")
        self._one_of("score_type", "distance_zscore", "dot_product")
        self._one_of("tree_type", "NJ", "UPGMA")
        self._one_of("distance_base", "averaged_value", "score_with_seed")
        self._one_of("scoring_matrix", "BLOSUM62")
        if self.gap_open_penalty is not None and self.gap_open_penalty > 0:
            raise ValueError("gap_open_penalty must not be positive")
        if self.max_cluster_size != -1 and self.max_cluster_size <= 10:
            raise ValueError("max_cluster_size must be -1 or above 10")
        if self.random_seed <= 0:
            raise ValueError("random_seed must be positive")
        if self.num_iter < 1 or self.num_seed_seqs < 1:
            raise ValueError("num_iter and num_seed_seqs must be positive")

    def _one_of(self, name, *allowed):
        if getattr(self, name) not in allowed:
            raise ValueError(f"{name} must be one of {allowed}")

    @property
    def is_local(self) -> bool:
        return self.alignment_type == "local"


#: Options that name files, with whether one of a group is needed.
INPUTS, OUTPUTS = ("in", "in_list", "in_fasta"), ("out", "out_stats")
FILES = (*INPUTS, "in_stats", *OUTPUTS, "out_matrix")


def parse_arguments(arguments: list[str]) -> tuple[AlignOptions, dict[str, str]]:
    """Options and file names from a command line of --name value tokens.

    A flag without a value is true; a token that starts with -- is no value.
    Unknown or repeated options, wrong values, no input, no output, and
    options that exclude each other raise ValueError, with all complaints in
    one message.
    """
    given: dict[str, str] = {}
    errors: list[str] = []
    at = 0
    while at < len(arguments):
        token = arguments[at]
        at += 1
        if not token.startswith("--"):
            errors.append(f"unexpected value {token}")
            continue
        value = "true"
        if at < len(arguments) and not arguments[at].startswith("--"):
            value = arguments[at]
            at += 1
        name = token[2:]
        if name in given:
            errors.append(f"--{name} is repeated")
        given[name] = value
    known = {f.name: f for f in fields(AlignOptions)}
    values, files = {}, {}
    for name, text in given.items():
        if name in FILES:
            files[name] = text
        elif name not in known:
            errors.append(f"unknown option --{name}")
        else:
            try:
                values[name] = _value(str(known[name].type), text)
            except ValueError:
                errors.append(f"--{name} can't be {text}")
    on = lambda n: given.get(n, "").lower() not in _FALSE
    if on("a3m_pairwise") and (on("out_matrix") or on("max_cluster_size")):
        errors.append("--a3m_pairwise excludes --out_matrix and --max_cluster_size")
    if on("gap_open_penalty") and on("gap_penalty_auto_adjust"):
        errors.append("--gap_open_penalty excludes --gap_penalty_auto_adjust")
    if not any(n in files for n in INPUTS):
        errors.append("an input is needed: " + ", ".join(f"--{n}" for n in INPUTS))
    if not any(n in files for n in OUTPUTS):
        errors.append("an output is needed: " + ", ".join(f"--{n}" for n in OUTPUTS))
    errors = [e for e in errors if e != "unknown option --gap_penalty_auto_adjust"]
    if not errors:
        try:
            return AlignOptions(**values), files
        except ValueError as error:
            errors.append(str(error))
    raise ValueError("; ".join(errors))


def _value(kind: str, text: str):
    if kind.startswith("bool"):
        if text.lower() not in ("true", "false", "1", "0"):
            raise ValueError(text)
        return text.lower() in ("true", "1")
    if kind.startswith("int"):
        return int(text)
    if kind.startswith("float"):
        return float(text)
    if kind.startswith("tuple"):
        a, b = text.split(",")
        return float(a), float(b)
    return text
