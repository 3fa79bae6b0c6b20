"""Run configuration: sections of plain keys, strict about names and types, from dictionaries and YAML files."""

from __future__ import annotations

import json
from typing import Any

# The sections of a run file with their keys, types and defaults.  A
# question mark allows null, which is the default where none is given; ``=[a, b]`` lists
# the only values allowed, the first being the default; ``[x]`` is a list of sections x.
SECTIONS = """
project: name str "" | run_name str "base" | seed int 42 | data_seed int 42 | init_seed int 42 | sampling_seed int 1234
model: vocab_size int 32768 | context_length int 1024 | n_layer int 12 | d_model int 768 | n_head int 12 | n_kv_head int? | head_dim int? | d_ff int? | norm =[rmsnorm, layernorm] | positional_encoding =[rope, learned] | activation =[swiglu, gelu] | norm_eps float 1e-5 | rope_theta float 10000.0 | tie_word_embeddings bool true | bias bool false | dropout float 0.0 | initializer_range float 0.02
tokenizer: path str "artifacts/tokenizer"
source: name str! | weight float 1.0 | split str "train" | path str? | revision str? | subset str? | text_key str "text"
data: sources [source] | sampling_seed int 42 | min_doc_chars int 16 | mixture_weighting =[token, document] | val_sources [source]
training: precision =[fp16, bf16, fp32] | global_batch_tokens int 262144 | micro_batch_size int 4 | grad_accum_steps int? | max_tokens int 2500000000 | grad_clip float 1.0 | log_interval int 10 | eval_interval int 1000 | eval_tokens int 10000000 | downstream_interval int 1000 | resume_fastforward bool true
optimizer: name =[adamw] | learning_rate float 6e-4 | beta1 float 0.9 | beta2 float 0.95 | weight_decay float 0.1 | eps float 1e-8
scheduler: name =[cosine] | warmup_ratio float 0.02 | min_lr_ratio float 0.1
distributed: backend str "nccl" | find_unused_parameters bool false
task: name str! | path str! | language =[en, ko] | enabled bool true | during_training bool true
evaluation: generation_prompts_en list | generation_prompts_ko list | sampling_seed int 1234 | downstream_enabled bool true | downstream_batch_size int 16 | downstream_tasks [task]
logging: backend =[wandb, none] | project str "" | wandb_run_id str?
checkpoint: dir str "artifacts/checkpoints" | save_interval int 1000 | keep_last int 3 | save_best bool true
"""
#: Sections of the file itself; the others are elements of lists.
TOP = ["project", "model", "tokenizer", "data", "training", "optimizer", "scheduler", "distributed", "evaluation", "logging", "checkpoint"]


class Section(dict):
    """A dictionary whose keys are attributes too."""

    def __getattr__(self, key: str) -> Any:
        try:
            return self[key]
        except KeyError:
            raise AttributeError(key) from None

    def __setattr__(self, key: str, value: Any) -> None:
        self[key] = value


def _schema() -> dict[str, dict[str, str]]:
    lines = (line.split(": ", 1) for line in SECTIONS.strip().splitlines())
    return {name: dict(part.strip().split(" ", 1) for part in keys.split(" | ")) for name, keys in lines}


SCHEMA = _schema()


def _number(kind: type, value: Any, at: str) -> Any:
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"{at}: {value!r} is no number") from None
    if kind is int and not number.is_integer():
        raise ValueError(f"{at}: {value!r} is no whole number")
    return int(value if isinstance(value, int) else number) if kind is int else number


def _value(rule: str, value: Any, at: str) -> Any:
    if rule.startswith("=["):
        allowed = rule[2:-1].split(", ")
        if value not in allowed:
            raise ValueError(f"{at} is one of {', '.join(allowed)}, not {value!r}")
        return value
    if rule.startswith("["):
        return [section(rule[1:-1], v, f"{at}.") for v in value or []]
    kind = rule.split(" ")[0].rstrip("?!")
    if value is None and "?" in rule.split(" ")[0]:
        return None
    if kind in ("int", "float"):
        if isinstance(value, bool):
            raise ValueError(f"{at}: {value!r} is no number")
        return _number(int if kind == "int" else float, value, at)
    expected = {"str": str, "bool": bool, "list": list}[kind]
    if not isinstance(value, expected):
        raise ValueError(f"{at}: {value!r} is no {kind}")
    return value


def _default(rule: str, at: str) -> Any:
    if rule.startswith("=["):
        return rule[2:-1].split(", ")[0]
    if rule.startswith("[") or rule == "list":
        return []
    kind, _, given = rule.partition(" ")
    if kind.endswith("!"):
        raise ValueError(f"{at} is needed")
    return json.loads(given) if given else None


def section(name: str, values: dict | None, above: str = "") -> Section:
    """A section with defaults for what is missing; unknown keys are an error."""
    known, values = SCHEMA[name], values or {}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"{above}{name} has no {', '.join(unknown)}")
    return Section({k: _value(rule, values[k], f"{above}{name}.{k}") if k in values else _default(rule, f"{above}{name}.{k}") for k, rule in known.items()})


def ffn_width(d_model: int, activation: str, multiple: int = 128) -> int:
    """Width of the feed-forward layer: four times the model's, or 8/3 where it is gated, rounded up."""
    wanted = 4 * d_model if activation == "gelu" else 8 * d_model // 3
    return -(-wanted // multiple) * multiple


class RunConfig(Section):
    """All sections of a run file."""

    @classmethod
    def from_dict(cls, values: dict | None) -> RunConfig:
        values = values or {}
        if unknown := sorted(set(values) - set(TOP)):
            raise ValueError(f"a run has no {', '.join(unknown)}")
        run = cls({name: section(name, values.get(name)) for name in TOP})
        m = run.model
        if m.n_kv_head is None:
            m.n_kv_head = m.n_head
        if m.head_dim is None:
            if m.d_model % m.n_head:
                raise ValueError("model.d_model must be a multiple of model.n_head")
            m.head_dim = m.d_model // m.n_head
        if m.n_head % m.n_kv_head:
            raise ValueError("model.n_head must be a multiple of model.n_kv_head")
        if m.d_ff is None:
            m.d_ff = ffn_width(m.d_model, m.activation)
        return run

    @classmethod
    def from_yaml(cls, path: str) -> RunConfig:
        return cls.from_dict(load_yaml(path))

    def to_dict(self) -> dict:
        return json.loads(json.dumps(self))

    def to_json(self) -> str:
        return json.dumps(self, ensure_ascii=False, indent=2)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())


def load_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


class TokenizerConfig(Section):
    """A tokenizer run: vocab_size, min_frequency, output_dir, seed, input_files and text_key."""

    #: Keys of the file, beside its ``data`` section, and their defaults.
    KEYS = {"vocab_size": 32768, "min_frequency": 2, "output_dir": "artifacts/tokenizer", "seed": 42}

    def __init__(self, input_files: list[str] | None = None, text_key: str = "text", **values: Any):
        if unknown := sorted(set(values) - set(self.KEYS)):
            raise ValueError(f"a tokenizer run has no {', '.join(unknown)}")
        super().__init__({**self.KEYS, **values, "input_files": input_files or [], "text_key": text_key})

    @classmethod
    def from_yaml(cls, path: str, input_files: list[str] | None = None) -> TokenizerConfig:
        values = load_yaml(path)
        values.pop("data", None)
        return cls(input_files, **values)


def tokenizer_sources(path: str):
    """Sources of a tokenizer file's ``data`` section, and its size in GB, the sum over them."""
    from millrace.sources.readers import Source

    entries = load_yaml(path).get("data") or {}
    if not entries:
        raise ValueError(f"{path} has no data section")
    sources = [Source(name=e["name"], subset=e.get("subset"), weight=float(e.get("weight", 1.0))) for e in entries.values()]
    return sources, sum(float(e.get("target_gb", 0.0)) for e in entries.values())


def may_resume(saved: dict, now: RunConfig, world: int) -> list[str]:
    """What differs from the run that wrote ``saved`` and would change which blocks are read."""
    asked = {"world": world, "context_length": now.model.context_length, "micro_batch_size": now.training.micro_batch_size, "sampling_seed": now.data.sampling_seed, "mixture_weighting": now.data.mixture_weighting}
    return sorted(k for k, v in asked.items() if k in saved and saved[k] != v)
