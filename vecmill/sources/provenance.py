"""Where a result comes from: one record of the model, its data, its training and its
evaluation.  What no file or setting tells is null, and so is what would be derived from it."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .tables import listing, read_json

#: Fields that are taken from the training's settings as they are, by section (fixed names).
COPIED = {
    "model": ("head_dims", "teacher_dir", "teacher_md5"),
    "data": ("data_root", "max_samples_per_source"),
    "training": ("seed", "epochs", "per_device_batch_size", "grad_accum", "learning_rate", "warmup_ratio", "weight_decay", "loss_temperature", "max_visual_tokens", "grad_checkpointing", "train_runtime_seconds"),
    "eval": ("eval_root", "max_visual_tokens", "bidirectional_attention", "embed_batch", "num_workers"),
}
#: Names of the three training objectives and of models without an adapter, in records.
LABELS = {"listwise": "listwise", "hardneg": "hardneg", "in-batch": "in-batch", "adapter": "LoRA", "whole": "full-ft", "merged": "merged"}


def product(*factors: float | None) -> float | None:
    """Null where a factor is unknown."""
    out = 1
    for f in factors:
        if f is None:
            return None
        out *= f
    return out


def last_checkpoint(spark: SparkSession, folder: str) -> tuple[dict, int | None]:
    """State of the checkpoint with the highest number and how many processes left their
    random state in it; ``({}, None)`` without a checkpoint."""
    numbered = [(int(m[1]), n) for n, _ in listing(spark, folder) if (m := re.match(r"checkpoint-(\d+)\Z", n))]
    if not numbered:
        return {}, None
    path = f"{folder}/{max(numbered)[1]}"
    processes = sum(bool(re.match(r"rng_state_.*\.pth\Z", n)) for n, _ in listing(spark, path))
    return read_json(spark, f"{path}/trainer_state.json"), processes or None


def first_line(spark: SparkSession, folder: str, name: str) -> str:
    """Text of a small file without white space around it, empty if there is none."""
    if name not in (n for n, is_folder in listing(spark, folder) if not is_folder):
        return ""
    rows = spark.read.text(f"{folder}/{name}", wholetext=True).head(1)
    return rows[0].value.strip() if rows else ""


def objective(training: Mapping) -> str:
    """``listwise``, ``hardneg`` or ``in-batch``."""
    if training.get("hardneg_loss") == "listwise":
        return "listwise"
    return "hardneg" if training.get("use_hardnegatives") else "in-batch"


def run_record(spark: SparkSession, run: Mapping, training: Mapping, sizes: Iterable[tuple[str, int]] = (), world: int = 1, protocol: str | None = None, labels: Mapping[str, str] = LABELS) -> dict:
    """``model, data, training, eval`` of a run.

    ``run`` are the evaluation's settings (``run_name, base_model, adapter_dir,
    skip_adapter_weights, bidirectional_attention, head_dim, attn, eval_root, datasets,
    max_queries, max_docs, ...``), ``training`` those that the training left behind,
    ``sizes`` name and number of components of the model's tensors (of their headers)."""
    adapter = run.get("adapter_dir")
    merged = bool(run.get("skip_adapter_weights"))
    low_rank = read_json(spark, f"{adapter}/adapter_config.json") if adapter and not merged else {}
    base = read_json(spark, f"{run['base_model']}/config.json")
    root = training.get("data_root")
    export = read_json(spark, f"{root}/export_stats.json") if root else {}
    state, processes = last_checkpoint(spark, adapter) if adapter else ({}, None)
    kind = objective(training)
    mined = kind != "in-batch"

    steps = training.get("steps") or state.get("global_step")
    trained_on = training.get("world_size") or processes
    batch = product(training.get("per_device_batch_size"), training.get("grad_accum"), trained_on)
    sizes = list(sizes)
    total, tuned = sum(n for _, n in sizes), sum(n for name, n in sizes if "lora_" in name)
    form = "merged" if merged else "adapter" if low_rank else "whole"
    attention = "bidir" if run.get("bidirectional_attention") == "on" else "causal"
    text = base.get("text_config") or {}
    head = run.get("head_dim")

    record = {part: {k: (run if part == "eval" else training).get(k) for k in fields} for part, fields in COPIED.items()}
    record["model"] |= {
        "run_name": run.get("run_name"), "adapter_dir": adapter, "base_model": training.get("base_model") or run["base_model"],
        "experiment_type": "/".join((labels[form], attention, kind)),
        "total_params": total, "trainable_params": tuned, "trainable_ratio": round(tuned / total, 6) if total else None,
        "emb_dim": base.get("dim") if head is None else head, "head_dim": head,
        "hidden_size": text.get("hidden_size"), "num_hidden_layers": text.get("num_hidden_layers"),
        "dtype": "bfloat16", "attn": run.get("attn"), "git_hash": first_line(spark, adapter, "git_hash.txt") if adapter else "",
    }
    record["data"] |= {
        "version": export.get("version"), "policy": export.get("policy"), "train_pairs": export.get("written_rows"), "by_source": export.get("by_source"),
        "hardneg_root": training.get("listwise_root" if kind == "listwise" else "hardneg_root") if mined else None,
        "num_hard_negs": training.get("num_hard_negs") if kind == "hardneg" else None,
    }
    record["training"] |= {
        "epoch_done": state.get("epoch"), "steps": steps, "world_size": trained_on,
        "effective_batch_size": batch, "consumed_samples": product(steps or None, batch or None), "lr_scheduler": "cosine",
        "lora_r": low_rank.get("r", training.get("lora_r")), "lora_alpha": low_rank.get("lora_alpha", training.get("lora_alpha")),
        "lora_dropout": low_rank.get("lora_dropout", training.get("lora_dropout")), "lora_target_modules": low_rank.get("target_modules"),
        "loss": labels[kind], "in_batch_term_weight": training.get("hardneg_in_batch_weight") if mined else None,
    }
    record["eval"] |= {
        "eval_protocol": protocol, "world_size": world,
        **{out: run.get(own) or None for out, own in (("datasets_filter", "datasets"), ("max_queries", "max_queries"), ("max_docs", "max_docs"))},
        "truncated": bool(run.get("max_queries") or run.get("max_docs")), "date": datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"),
    }
    return record
