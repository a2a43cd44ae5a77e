"""Gradients against differences, and training that separates what it should."""

from __future__ import annotations

import numpy as np
import pytest

from quillmesh.functions.autograd import Var
from quillmesh.functions.towers import ContextTower, PaperTower
from quillmesh.plans import training


@pytest.mark.parametrize("act,mlp,heads", [("none", False, 1), ("leaky_relu", False, 2), ("sigmoid", True, 1), ("relu", True, 3)])
def test_gradients(act, mlp, heads):
    rng = np.random.default_rng(0)
    paper = PaperTower(["P", "PP"], 6, 6, 4, n_fp_layers=2, num_heads=heads, act=act, use_mlp=mlp).initialise()
    paper.weights["gamma"] = np.array([0.7])
    context = ContextTower(5, 4, tuned=True).initialise()
    x, f = rng.normal(size=(3, 5)), rng.normal(size=(3, 2, 6))

    def loss():
        wc, wp = ({k: Var(v) for k, v in t.weights.items()} for t in (context, paper))
        made = training.paper_forward(paper, wp, f)
        assert np.allclose(made.value, paper.forward(f))
        assert np.allclose(training.context_forward(wc, x).value, context.forward(x))
        return training.contrastive_loss(training.context_forward(wc, x), made, 0.5), wc, wp

    value, wc, wp = loss()
    value.backward()
    for tower, grads in ((context, wc), (paper, wp)):
        for name in tower.weights:
            at = tuple(rng.integers(0, n) for n in tower.weights[name].shape)
            keep, side = tower.weights[name][at], []
            for step in (1e-6, -1e-6):
                tower.weights[name][at] = keep + step
                side.append(float(loss()[0].value.sum()))
            tower.weights[name][at] = keep
            assert grads[name].grad[at] == pytest.approx((side[0] - side[1]) / 2e-6, abs=1e-5), name


def test_training_keeps_the_best_and_stops(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(24, 6))
    records = spark.createDataFrame([(k, k // 2, k, (base[k] + 0.05 * rng.normal(size=6)).tolist()) for k in range(24)], "record_id long, context_group_id long, cited_paper_id long, vec array<double>")
    features = spark.createDataFrame([(k, base[k].tolist(), base[(k + 1) % 24].tolist()) for k in range(24)], "id long, P array<double>, PP array<double>")
    settings = training.Settings(epochs=25, batch_size=6, temperature=0.2, lr_head=0.02, lr_paper=0.02, patience=25)
    stored = [list(training.batches(records, features, ["P", "PP"], settings, e)) for e in range(2)]
    assert sum(len(x) for x, _ in stored[0]) == 24 and all(len(x) <= 6 and f.shape[1:] == (2, 6) for x, f in stored[0])
    context, paper = ContextTower(6, 8).initialise(), PaperTower(["P", "PP"], 6, 8, 8).initialise()
    f = np.stack([base, np.roll(base, -1, axis=0)], axis=1)

    def mrr(tower, weights):
        frozen = PaperTower(["P", "PP"], 6, 8, 8, weights=weights)
        s = tower.forward(base) @ frozen.forward(f).T
        return {"mrr": float((1 / (1 + (s > np.diag(s)[:, None]).sum(axis=1))).mean())}

    history = training.train(context, paper, lambda e: iter(stored[e % 2]), mrr, settings)
    assert history[-1]["train_loss"] < 0.5 * history[0]["train_loss"] and max(h["mrr"] for h in history) > 0.8
    flat = training.train(context, paper, lambda e: iter(stored[0]), lambda *_: {"mrr": 0.1}, training.Settings(9, 6, 0.2, 0.0, 0.0, 2))
    assert [h["improved"] for h in flat] == [True, False, False]
    training.save(str(tmp_path / "w.npz"), context, paper, {"epoch": 3})
    assert training.load(str(tmp_path / "w.npz"))[2] == {"epoch": 3}
    again = training.load(str(tmp_path / "w.npz"))
    assert np.allclose(again[0].forward(base), context.forward(base)) and np.allclose(again[1].forward(f), paper.forward(f))


def test_a_batch_that_is_not_finite_counts_as_zero():
    context, paper = ContextTower(2, 2).initialise(), PaperTower(["P"], 2, 2, 2).initialise()
    bad = (np.full((2, 2), np.nan), np.ones((2, 1, 2)))
    before = {k: v.copy() for k, v in context.weights.items()}
    assert training.train_epoch(context, paper, iter([bad]), training.Adam(training.groups(context, paper, training.Settings(1, 2, 0.1, 1.0, 1.0, 1)), 1.0), 0.1) == 0
    assert all((context.weights[k] == v).all() for k, v in before.items())


def test_dropout_keeps_the_mean_and_ends_with_training():
    x = Var(np.ones((400, 50)))
    settings = training.Settings(1, 2, 0.1, 1.0, 1.0, 1, input_drop=0.4)
    dropped = training.Dropout(settings, 0)(x, "input").value
    assert abs((dropped == 0).mean() - 0.4) < 0.02 and abs(dropped.mean() - 1) < 0.05
    assert training.Dropout(settings, 0)(x, "attention") is x


def test_three_rates():
    context, paper = ContextTower(4, 4, tuned=True).initialise(), PaperTower(["P"], 4, 4, 4).initialise()
    rng = np.random.default_rng(0)
    batch = rng.normal(size=(6, 4)), rng.normal(size=(6, 1, 4))
    before = {k: v.copy() for k, v in (context.weights | paper.weights).items()}
    optimiser = training.Adam(training.groups(context, paper, training.Settings(1, 6, 0.1, 0.0, 0.01, 1, lr_encoder=0.001)), 10.0)
    training.train_epoch(context, paper, iter([batch]), optimiser, 0.1)
    moved = {k: float(np.abs(v - before[k]).max()) for k, v in (context.weights | paper.weights).items()}
    assert moved["proj.w"] == 0 and 0 < moved["encoder.w"] < 0.0011 < moved["head.w"] < 0.011


def test_train_save_and_infer(spark, tmp_path, capsys):
    """From a graph to recommendations through the command line: build, train, evaluate, recommend."""
    import json

    from quillmesh import __main__ as cli

    words = ["river", "stone", "tree", "cloud", "metal", "paper", "sound", "light", "grain", "water", "glass", "smoke"]
    titles = "\n".join(f'<b/paper/p{k}> <http://purl.org/dc/terms/title> "About {w}" .' for k, w in enumerate(words))
    cites = "\n".join(f"<b/paper/p{k}> <http://purl.org/spar/cito/cites> <b/paper/p{(k + 1) % 12}> ." for k in range(12))
    (tmp_path / "graph.ttl").write_text(titles + "\n" + cites)
    rows = [{"context": f"{w} and {w} of kind {j}", "cited_uri": f"b/paper/p{k}", "citing_uri": f"b/paper/p{(k + j) % 12}", "citing_idx": j, "citation_type": "single", "context_group_id": 20 * k + j} for k, w in enumerate(words) for j in range(1, 9)]
    (tmp_path / "contexts.json").write_text(json.dumps(rows))
    (tmp_path / "abstracts.json").write_text(json.dumps({f"b/paper/p{k}": f"{w} {w} {w}" for k, w in enumerate(words)}))
    at = lambda name: str(tmp_path / name)
    keep = spark.stop
    spark.stop = lambda: None
    try:
        cli.main(["build", "--graph", at("graph.ttl"), "--contexts", at("contexts.json"), "--abstracts", at("abstracts.json"), "--paper-prefix", "b/paper/", "--citation-prefix", "b/citation/", "--out", at("data")])
        cfg = {
            "data_root": at("data"), "output_dir": at("runs"), "experiment_name": "one", "feat_keys": ["P", "PP"], "hidden": 32, "embed_dim": 16, "n_fp_layers": 1, "num_heads": 1, "act": "none", "residual": True, "use_mlp": False,
            "dropout": 0.1, "input_drop": 0.05, "att_drop": 0.1, "temperature": 0.1, "epochs": 3, "batch_size": 24, "max_length": 256, "lr_scibert": 1e-3, "lr_head": 0.02, "lr_paper": 0.02, "patience": 3, "seed": 42, "test_eval_every": 2,
        }
        (tmp_path / "cfg.json").write_text(json.dumps(cfg))
        cli.main(["train", "--config", at("cfg.json")])
        run = tmp_path / "runs" / "one"
        told = json.loads((run / "history.json").read_text())
        assert json.loads((run / "config.json").read_text()) == cfg and told["epochs_run"] == 3 == len(told["history"]) and told["best_mrr"] > 0.2
        assert [h["epoch"] for h in json.loads((run / "test_curve.json").read_text())["history"]] == [2, 3]
        assert told["best_epoch"] == training.load(str(run / "best_model.npz"))[2]["epoch"]
        cli.main(["evaluate", "--checkpoint", str(run / "best_model.npz"), "--data", at("data"), "--split", "train"])
        cli.main(["recommend", "--checkpoint", str(run / "best_model.npz"), "--data", at("data"), "--query", "river and river", "--topk", "3"])
        printed = capsys.readouterr().out
        assert "mrr" in printed and "<b/paper/p" in printed and "About " in printed
        with pytest.raises(KeyError):
            cli.main(["train", "--config", at("short.json")] if (tmp_path / "short.json").write_text("{}") else [])
    finally:
        spark.stop = keep
