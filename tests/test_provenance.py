"""The record of a run: fallbacks, strict nulls, objectives."""

import json

import pytest

from vecmill.sources import provenance as P


@pytest.fixture
def run(tmp_path):
    def put(path, value):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(value if isinstance(value, str) else json.dumps(value))

    put("base/config.json", {"dim": 128, "text_config": {"hidden_size": 2560, "num_hidden_layers": 36}})
    put("arm/adapter_config.json", {"r": 32, "target_modules": ["q", "v"]})
    put("arm/git_hash.txt", " abc123\n")
    put("arm/checkpoint-900/trainer_state.json", {"global_step": 900, "epoch": 0.5})
    put("arm/checkpoint-1800/trainer_state.json", {"global_step": 1800, "epoch": 1.0})
    put("arm/checkpoint-last/trainer_state.json", {"global_step": 7})
    for i in range(4):
        put(f"arm/checkpoint-1800/rng_state_{i}.pth", "x")
    put("data/export_stats.json", {"version": "v3", "written_rows": 10, "by_source": {"a": 10}})
    return {"run_name": "r", "base_model": f"{tmp_path}/base", "adapter_dir": f"{tmp_path}/arm", "bidirectional_attention": "on", "max_queries": 5, "data": f"{tmp_path}/data"}


def test_files_fill_what_settings_leave_open(spark, run):
    training = {"data_root": run["data"], "per_device_batch_size": 8, "grad_accum": 2, "lora_r": 8, "lora_alpha": 64, "use_hardnegatives": True, "hardneg_root": "h", "num_hard_negs": 3}
    got = P.run_record(spark, run, training, [("a.lora_A", 10), ("b", 90)], world=2, protocol="p")
    assert (got["training"]["steps"], got["training"]["epoch_done"], got["training"]["world_size"]) == (1800, 1.0, 4)
    assert (got["training"]["effective_batch_size"], got["training"]["consumed_samples"]) == (64, 115200)
    assert (got["training"]["lora_r"], got["training"]["lora_alpha"], got["training"]["lora_target_modules"]) == (32, 64, ["q", "v"])
    assert got["model"]["experiment_type"] == "LoRA/bidir/hardneg" and got["model"]["git_hash"] == "abc123"
    assert (got["model"]["total_params"], got["model"]["trainable_params"], got["model"]["trainable_ratio"]) == (100, 10, 0.1)
    assert (got["model"]["emb_dim"], got["model"]["hidden_size"]) == (128, 2560)
    assert (got["data"]["train_pairs"], got["data"]["hardneg_root"], got["data"]["num_hard_negs"]) == (10, "h", 3)
    assert (got["eval"]["max_queries"], got["eval"]["max_docs"], got["eval"]["truncated"], got["eval"]["world_size"]) == (5, None, True, 2)
    json.dumps(got)


def test_settings_win_and_listwise_has_its_own_root(spark, run):
    training = {"steps": 10, "world_size": 1, "per_device_batch_size": 1, "grad_accum": 1, "hardneg_loss": "listwise", "listwise_root": "l", "num_hard_negs": 3, "hardneg_in_batch_weight": 0.5}
    got = P.run_record(spark, run | {"head_dim": 64, "skip_adapter_weights": True}, training)
    assert (got["training"]["steps"], got["training"]["consumed_samples"], got["training"]["in_batch_term_weight"]) == (10, 10, 0.5)
    assert (got["data"]["hardneg_root"], got["data"]["num_hard_negs"], got["model"]["emb_dim"]) == ("l", None, 64)
    assert got["model"]["experiment_type"] == "merged/bidir/listwise" and got["training"]["lora_target_modules"] is None


def test_unknown_factors_are_null(spark, tmp_path):
    got = P.run_record(spark, {"base_model": f"{tmp_path}/none"}, {"per_device_batch_size": 8, "grad_accum": 2, "steps": 5, "hardneg_root": "h"})
    assert got["training"]["effective_batch_size"] is None and got["training"]["consumed_samples"] is None
    assert (got["data"]["hardneg_root"], got["model"]["trainable_ratio"], got["model"]["git_hash"]) == (None, None, "")
    assert got["model"]["experiment_type"] == "full-ft/causal/in-batch" and not got["eval"]["truncated"]
    assert P.product() == 1 and P.product(0, 3) == 0 and P.product(2, None) is None
