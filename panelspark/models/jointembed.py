"""M3-M6: shared-encoder joint-embedding predictor, trained and scored on executors with numpy.

Network: three modality encoders Linear(d,32) -> LayerNorm -> ReLU -> Dropout(.2) ->
Linear(32,16) -> ReLU, shared by visit 1 and visit 2; the two 48-value visit embeddings are
concatenated (96) -> Linear 64 -> LayerNorm -> ReLU -> Dropout(.3) -> Linear 32 -> ReLU ->
Linear 1 (logit).  Loss: BCE with logits and a positive-class weight.

Training is data parallel: each epoch is one Spark job.  Weights and Adam moments are
broadcast, every partition runs Adam over its rows in mini-batches of 32 (batch order and
dropout masks are pure functions of (seed, epoch, subject)), returns its updated state, and
the driver averages the states weighted by rows.  With one partition this is plain
sequential mini-batch Adam.  A task takes several partitions through their batches side by
side (one numpy call a layer for all of them); a partition's result does not depend on its
neighbours.  Validation loss is a distributed forward pass.  Learning rate
halves after 5 epochs without improvement; training stops after 15 and keeps the best state.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelspark.session import checkpoint_dir
from panelspark.operators.features import LabelEncoder, MODALITIES, Standardiser
from panelspark.spec import GROUP, LABEL

# Architecture and training hyper-parameters.
HIDDEN, EMBED = 32, 16
MOD_DIMS = {"cognitive": 2, "brain": 3, "demographic": 4}
ENC_DROPOUT, HEAD_DROPOUT = 0.2, 0.3
LR, EPOCHS, BATCH, PATIENCE, LR_PATIENCE, LR_FACTOR = 1e-3, 100, 32, 15, 5, 0.5
BETA1, BETA2, ADAM_EPS, LN_EPS = 0.9, 0.999, 1e-8, 1e-5
SEED = 42

PARAM_SHAPES = []
for _m, _d in MOD_DIMS.items():
    PARAM_SHAPES += [(f"{_m}.w1", (_d, HIDDEN)), (f"{_m}.b1", (HIDDEN,)), (f"{_m}.g", (HIDDEN,)), (f"{_m}.be", (HIDDEN,)),
                     (f"{_m}.w2", (HIDDEN, EMBED)), (f"{_m}.b2", (EMBED,))]
PARAM_SHAPES += [("p.w1", (6 * EMBED, 64)), ("p.b1", (64,)), ("p.g", (64,)), ("p.be", (64,)),
                 ("p.w2", (64, 32)), ("p.b2", (32,)), ("p.w3", (32, 1)), ("p.b3", (1,))]
N_PARAMS = sum(int(np.prod(s)) for _, s in PARAM_SHAPES)


def init_params(seed: int = SEED) -> dict:
    """Uniform(-1/sqrt(fan_in), 1/sqrt(fan_in)) for linear layers; LayerNorm gain 1, bias 0."""
    rng = np.random.default_rng(seed)
    p = {}
    fan = {}
    for name, shape in PARAM_SHAPES:
        layer = name.rsplit(".", 1)[0] + "." + name.rsplit(".", 1)[1][-1]
        if name.endswith((".g",)):
            p[name] = np.ones(shape)
        elif name.endswith(".be"):
            p[name] = np.zeros(shape)
        elif ".w" in name:
            fan[layer] = shape[0]
            b = 1.0 / math.sqrt(shape[0])
            p[name] = rng.uniform(-b, b, shape)
        else:
            b = 1.0 / math.sqrt(fan[layer])
            p[name] = rng.uniform(-b, b, shape)
    return p


def flatten(p: dict) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n, _ in PARAM_SHAPES])


def unflatten(v: np.ndarray) -> dict:
    """Views of the parameters; of a matrix with one state a row, stacked along the first axis."""
    out, i = {}, 0
    for n, s in PARAM_SHAPES:
        k = int(np.prod(s))
        out[n] = v[i:i + k].reshape(s) if v.ndim == 1 else v[:, i:i + k].reshape(len(v), *(s if len(s) == 2 else (1, *s)))
        i += k
    return out


# ── keyed randomness (vectorised splitmix64) ─────────────────────────────────

_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) & _M
        x = ((x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)) & _M
        x = ((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)) & _M
        return x ^ (x >> np.uint64(31))


def keyed_uniforms(keys: np.ndarray, *salts: int, width: int = 1) -> np.ndarray:
    """Uniform [0,1) array of shape (len(keys), width), a pure function of (key, salts, column)."""
    k = keys.astype(np.uint64)
    for s in salts:
        k = _mix(k ^ np.uint64(s & 0xFFFFFFFFFFFFFFFF))
    cols = np.arange(width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = _mix(k[:, None] ^ ((cols[None, :] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) & _M))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


# ── forward / backward ───────────────────────────────────────────────────────

def _t(x):
    return np.swapaxes(x, -1, -2)


def _ln_fwd(h, g, be):
    mu = h.mean(-1, keepdims=True)
    var = h.var(-1, keepdims=True)
    inv = 1.0 / np.sqrt(var + LN_EPS)
    xh = (h - mu) * inv
    return xh * g + be, (xh, inv)


def _ln_bwd(dy, cache, g):
    xh, inv = cache
    dxh = dy * g
    n = xh.shape[-1]
    dh = inv / n * (n * dxh - dxh.sum(-1, keepdims=True) - xh * (dxh * xh).sum(-1, keepdims=True))
    return dh, _rows(dy * xh), _rows(dy)


def _rows(x):
    """Sums over a batch's rows, shaped like a bias."""
    return x.sum(-2, keepdims=x.ndim == 3)


def _encoder_fwd(p, m, x, mask):
    h = x @ p[f"{m}.w1"] + p[f"{m}.b1"]
    ln, lc = _ln_fwd(h, p[f"{m}.g"], p[f"{m}.be"])
    r = np.maximum(ln, 0)
    d = r * mask if mask is not None else r
    o = d @ p[f"{m}.w2"] + p[f"{m}.b2"]
    return np.maximum(o, 0), (x, lc, ln, r, d, o, mask)


def _encoder_bwd(p, m, dout, cache, grads):
    x, lc, ln, r, d, o, mask = cache
    do = dout * (o > 0)
    grads[f"{m}.w2"] += _t(d) @ do
    grads[f"{m}.b2"] += _rows(do)
    dd = do @ _t(p[f"{m}.w2"])
    dr = dd * mask if mask is not None else dd
    dln = dr * (ln > 0)
    dh, dg, dbe = _ln_bwd(dln, lc, p[f"{m}.g"])
    grads[f"{m}.g"] += dg
    grads[f"{m}.be"] += dbe
    grads[f"{m}.w1"] += _t(x) @ dh
    grads[f"{m}.b1"] += _rows(dh)


def visit_embedding(p, cog, brain, demo, masks=None):
    """M4: 48-value embedding of one visit (same weights for every visit)."""
    outs, caches = [], []
    for m, x in (("cognitive", cog), ("brain", brain), ("demographic", demo)):
        o, c = _encoder_fwd(p, m, x, None if masks is None else masks[m])
        outs.append(o)
        caches.append(c)
    return np.concatenate(outs, -1), caches


def forward(p, batch, masks=None):
    """M5: logits for a batch {cognitive_v1, ..., demographic_v2}; masks are dropout masks
    (already scaled by 1/(1-p)) or None for evaluation.  With stacked parameters the batch has a
    leading axis as well: one batch for every state."""
    e1, c1 = visit_embedding(p, batch["cognitive_v1"], batch["brain_v1"], batch["demographic_v1"],
                             None if masks is None else masks["v1"])
    e2, c2 = visit_embedding(p, batch["cognitive_v2"], batch["brain_v2"], batch["demographic_v2"],
                             None if masks is None else masks["v2"])
    t = np.concatenate([e1, e2], -1)
    h = t @ p["p.w1"] + p["p.b1"]
    ln, lc = _ln_fwd(h, p["p.g"], p["p.be"])
    r = np.maximum(ln, 0)
    hm = None if masks is None else masks["head"]
    d = r * hm if hm is not None else r
    h2 = d @ p["p.w2"] + p["p.b2"]
    r2 = np.maximum(h2, 0)
    z = (r2 @ p["p.w3"] + p["p.b3"])[..., 0]
    return z, (c1, c2, t, lc, ln, d, hm, h2, r2)


def backward(p, cache, dz):
    c1, c2, t, lc, ln, d, hm, h2, r2 = cache
    g = {n: np.zeros(w.shape) for n, w in p.items()}
    dz = dz[..., None]
    g["p.w3"] += _t(r2) @ dz
    g["p.b3"] += _rows(dz)
    dh2 = (dz @ _t(p["p.w3"])) * (h2 > 0)
    g["p.w2"] += _t(d) @ dh2
    g["p.b2"] += _rows(dh2)
    dd = dh2 @ _t(p["p.w2"])
    dr = dd * hm if hm is not None else dd
    dln = dr * (ln > 0)
    dh, dg, dbe = _ln_bwd(dln, lc, p["p.g"])
    g["p.g"] += dg
    g["p.be"] += dbe
    g["p.w1"] += _t(t) @ dh
    g["p.b1"] += _rows(dh)
    dt = dh @ _t(p["p.w1"])
    for half, caches in ((dt[..., :3 * EMBED], c1), (dt[..., 3 * EMBED:], c2)):
        for j, m in enumerate(("cognitive", "brain", "demographic")):
            _encoder_bwd(p, m, half[..., j * EMBED:(j + 1) * EMBED], caches[j], g)
    return g


def softplus(z):
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def bce_loss_grad(z, y, w):
    """M7 per row: w*y*softplus(-z) + (1-y)*softplus(z) and its derivative in z."""
    loss = w * y * softplus(-z) + (1 - y) * softplus(z)
    s = 1.0 / (1.0 + np.exp(-z))
    dz = w * y * (s - 1.0) + (1 - y) * s
    return loss, dz


def dropout_masks(keys, epoch, step, seed=SEED):
    n = len(keys)
    masks = {}
    for v, vis in ((1, "v1"), (2, "v2")):
        masks[vis] = {m: (keyed_uniforms(keys, seed, epoch, step, v, i, width=HIDDEN) >= ENC_DROPOUT) / (1 - ENC_DROPOUT)
                      for i, m in enumerate(("cognitive", "brain", "demographic"))}
    masks["head"] = (keyed_uniforms(keys, seed, epoch, step, 9, width=64) >= HEAD_DROPOUT) / (1 - HEAD_DROPOUT)
    return masks if n else None


def _keep(k: np.ndarray, width: int, p: float) -> np.ndarray:
    """keyed_uniforms(...) >= p, from keys that hold all salts but the column, as integers."""
    with np.errstate(over="ignore"):
        cols = (np.arange(width, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x = k[..., None] ^ cols
        x += np.uint64(0x9E3779B97F4A7C15)
        y = x >> np.uint64(30)
        x ^= y
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.right_shift(x, np.uint64(27), out=y)
        x ^= y
        x *= np.uint64(0x94D049BB133111EB)
        np.right_shift(x, np.uint64(31), out=y)
        x ^= y
    return x >= np.uint64(math.ceil(p * (1 << 53)) << 11)


def epoch_masks(keys, epoch, steps, seed=SEED):
    """``dropout_masks`` of many batches: ``keys`` of any shape, ``steps`` the batch start of each."""
    k = keys
    for s in (seed, epoch):
        k = _mix(k ^ np.uint64(s & 0xFFFFFFFFFFFFFFFF))
    k = _mix(k ^ steps.astype(np.uint64))
    masks = {}
    for v, vis in ((1, "v1"), (2, "v2")):
        kv = _mix(k ^ np.uint64(v))
        masks[vis] = {m: _keep(_mix(kv ^ np.uint64(i)), HIDDEN, ENC_DROPOUT) / (1 - ENC_DROPOUT)
                      for i, m in enumerate(("cognitive", "brain", "demographic"))}
    masks["head"] = _keep(_mix(k ^ np.uint64(9)), 64, HEAD_DROPOUT) / (1 - HEAD_DROPOUT)
    return masks


def train_side_by_side(shards: list, state: np.ndarray, steps_done: int, lr: float, epoch: int, pos_weight: float,
                       bsz: int = BATCH, seed: int = SEED, window: int = 8) -> list:
    """One epoch of Adam over every shard (keys, y, batch of all rows), each from ``state`` on its own:
    (rows, steps, loss, state) of each.  Step by step all shards' batches go through one stacked pass.
    Masks are drawn ``window`` steps at a time."""
    size = np.array([len(k) for k, _, _ in shards])
    by_size = np.argsort(-size, kind="stable")           # shards that still have batches are the first ones
    size, count = size[by_size], len(shards)
    total = -(-int(size[0]) // bsz) * bsz
    at = np.zeros((count, total), np.int64)              # rows in batch order
    base = np.concatenate([[0], np.cumsum(size)])
    for i, j in enumerate(by_size):
        keys = shards[j][0]
        at[i, :size[i]] = np.argsort(keyed_uniforms(keys, seed, epoch, 7)[:, 0], kind="stable")
        at[i] += base[i]
    keys, y = (np.concatenate([shards[j][c] for j in by_size]) for c in (0, 1))
    inputs = {n: np.concatenate([shards[j][2][n] for j in by_size]) for n in shards[0][2]}
    flat, m, v = (np.repeat(x[None], count, axis=0) for x in np.split(state, 3))
    loss_sum, steps, t = np.zeros(count), -(-size // bsz), steps_done
    for lo in range(0, total, window * bsz):
        hi = min(total, lo + window * bsz)
        live = int((size > lo).sum())
        rows = at[:live, lo:hi]
        masks = epoch_masks(keys[rows], epoch, np.arange(lo, hi) // bsz * bsz, seed)
        for s in range(lo, hi, bsz):
            full, some = int((size >= s + bsz).sum()), int((size > s).sum())
            for i, j in [(0, full)] * (full > 0) + [(i, i + 1) for i in range(full, some)]:      # short last batches go alone
                width = min(int(size[i]) - s, bsz)
                idx, cut = at[i:j, s:s + width], np.s_[i:j, s - lo:s - lo + width]
                step_masks = {k: {e: x[cut] for e, x in d.items()} if isinstance(d, dict) else d[cut] for k, d in masks.items()}
                w = unflatten(flat[i:j])
                z, cache = forward(w, {k: x[idx] for k, x in inputs.items()}, step_masks)
                loss, dz = bce_loss_grad(z, y[idx], pos_weight)
                g = backward(w, cache, dz / width)
                g = np.concatenate([g[k].reshape(j - i, -1) for k, _ in PARAM_SHAPES], axis=1)
                m[i:j] = BETA1 * m[i:j] + (1 - BETA1) * g
                v[i:j] = BETA2 * v[i:j] + (1 - BETA2) * g * g
                flat[i:j] -= lr * (m[i:j] / (1 - BETA1 ** (t + 1))) / (np.sqrt(v[i:j] / (1 - BETA2 ** (t + 1))) + ADAM_EPS)
                loss_sum[i:j] += [float(x.sum()) for x in loss]
            t += 1
    out = [None] * count
    for i, j in enumerate(by_size):
        out[j] = (int(size[i]), int(steps[i]), float(loss_sum[i]), np.concatenate([flat[i], m[i], v[i]]))
    return out


# ── Spark side ───────────────────────────────────────────────────────────────

INPUT_COLS = sorted({c for a, b in MODALITIES.values() for c in a + b})


def batch_from_pandas(pdf) -> dict:
    out = {}
    for name, (c1, c2) in MODALITIES.items():
        out[f"{name}_v1"] = pdf[c1].to_numpy(dtype=np.float64)
        out[f"{name}_v2"] = pdf[c2].to_numpy(dtype=np.float64)
    return out


class JointEmbeddingModel:
    def __init__(self, params: dict, threshold: float = 0.5, history: list | None = None):
        self.params = params
        self.threshold = threshold
        self.history = history or []

    def transform(self, df: DataFrame, model_name: str = "joint") -> DataFrame:
        """Long predictions (model, subject_id, participant_group, y, yhat, score), Arrow batches."""
        spark = df.sparkSession
        bc = spark.sparkContext.broadcast(flatten(self.params))
        thr = self.threshold

        def score(it):
            import pandas as pd
            p = unflatten(bc.value)
            for pdf in it:
                z, _ = forward(p, batch_from_pandas(pdf))
                s = 1.0 / (1.0 + np.exp(-z))
                yield pd.DataFrame({"model": model_name, "subject_id": pdf["subject_id"],
                                    "participant_group": pdf[GROUP], "y": pdf[LABEL].astype("int32"),
                                    "yhat": (s >= thr).astype("int32"), "score": s})

        cols = ["subject_id", GROUP, LABEL, *INPUT_COLS]
        return df.select(*cols).mapInPandas(
            score, "model string, subject_id string, participant_group string, y int, yhat int, score double")

    def embeddings(self, df: DataFrame, visit: int = 1) -> DataFrame:
        """M4: 48-value embedding of visit 1 or 2 per subject."""
        spark = df.sparkSession
        bc = spark.sparkContext.broadcast(flatten(self.params))
        v = f"v{visit}"

        def emb(it):
            import pandas as pd
            p = unflatten(bc.value)
            for pdf in it:
                b = batch_from_pandas(pdf)
                e, _ = visit_embedding(p, b[f"cognitive_{v}"], b[f"brain_{v}"], b[f"demographic_{v}"])
                yield pd.DataFrame({"subject_id": pdf["subject_id"], "embedding": list(e.astype(np.float32))})

        return df.select("subject_id", *INPUT_COLS).mapInPandas(emb, "subject_id string, embedding array<float>")


class JointEmbeddingEstimator:
    SIDE_BY_SIDE = 16            # partitions that a task trains, if there are more than cores (about 1 MB each)

    def __init__(self, epochs: int = EPOCHS, lr: float = LR, batch: int = BATCH, patience: int = PATIENCE,
                 seed: int = SEED, partitions: int | None = None, rows_per_partition: int = 4096):
        self.epochs, self.lr, self.batch, self.patience, self.seed = epochs, lr, batch, patience, seed
        self.partitions = partitions
        self.rows_per_partition = rows_per_partition

    def _prepare(self, df: DataFrame) -> DataFrame:
        key = F.conv(F.substring(F.md5(F.col("subject_id")), 1, 15), 16, 10).cast("long")
        return df.select(key.alias("_key"), F.col(LABEL).cast("double").alias("_y"), *INPUT_COLS)

    def fit(self, train: DataFrame, val: DataFrame, pos_weight: float) -> JointEmbeddingModel:
        spark = train.sparkSession
        sc = spark.sparkContext
        n = train.count()
        # the partition count, and with it the model, follows from the data alone
        parts = self.partitions or max(1, -(-n // self.rows_per_partition))
        # read every epoch: written once to the shared folder
        checkpoint_dir(spark)
        shard = F.pmod(F.hash("_key"), F.lit(parts)).alias("_shard")          # as repartition deals the rows
        tr = self._prepare(train).repartition(parts, "_key").select("*", shard).checkpoint()
        va = self._prepare(val).checkpoint()
        tr = tr.coalesce(max(min(parts, sc.defaultParallelism), -(-parts // self.SIDE_BY_SIDE)))
        params = init_params(self.seed)
        state = np.concatenate([flatten(params), np.zeros(N_PARAMS), np.zeros(N_PARAMS)])
        step_count, lr = 0, self.lr
        best, best_state, bad, sched_best, sched_bad = math.inf, None, 0, math.inf, 0
        history = []
        bsz, seed = self.batch, self.seed
        for epoch in range(self.epochs):
            bc = sc.broadcast((state, step_count, lr, epoch))

            def train_part(it, bc=bc):
                import pandas as pd
                st, t0, lr_, ep = bc.value
                frames = list(it)
                if not frames:
                    return
                pdf = pd.concat(frames, ignore_index=True)
                if len(pdf) == 0:
                    return
                shards = [(x["_key"].to_numpy().astype(np.uint64), x["_y"].to_numpy(), batch_from_pandas(x))
                          for _, x in pdf.groupby("_shard")]
                for n_rows, steps, loss, end in train_side_by_side(shards, st, t0, lr_, ep, pos_weight, bsz, seed):
                    yield pd.DataFrame({"n": [n_rows], "steps": [steps], "loss": [loss], "state": [end.tobytes()]})

            outs = tr.mapInPandas(train_part, "n long, steps long, loss double, state binary")
            state, steps, loss_sum, tot = self._average(outs, parts)
            step_count += steps
            train_loss = loss_sum / tot
            if not math.isfinite(train_loss):
                raise ValueError("the training loss is not a number: NULL or NaN among the inputs")
            val_loss = self._val_loss(va, state[:N_PARAMS], pos_weight)
            history.append((epoch + 1, train_loss, val_loss, lr))
            if val_loss < sched_best * (1 - 1e-4):
                sched_best, sched_bad = val_loss, 0
            else:
                sched_bad += 1
                if sched_bad > LR_PATIENCE:
                    lr, sched_bad = lr * LR_FACTOR, 0
            if val_loss < best:
                best, best_state, bad = val_loss, state[:N_PARAMS].copy(), 0
            else:
                bad += 1
            if bad >= self.patience:
                break
        return JointEmbeddingModel(unflatten(best_state if best_state is not None else state[:N_PARAMS]),
                                   history=history)

    @staticmethod
    def _average(outs: DataFrame, parts: int, collect_limit: int = 64, blocks: int = 32):
        """Row-weighted mean of the partition states.  Up to ``collect_limit`` partitions the
        states are collected (each ~255 KB); above it each state is cut into ``blocks`` slices
        and every slice is summed on an executor (groupBy(block)), so the driver receives one
        summed state, not one per partition.  Sums run in a fixed order, so reruns repeat."""
        if parts <= collect_limit:
            rows = sorted(outs.collect(), key=lambda r: r["state"][:64])
            tot = sum(r["n"] for r in rows)
            state = sum(np.frombuffer(r["state"], dtype=np.float64) * (r["n"] / tot) for r in rows)
            return state, max(r["steps"] for r in rows), sum(r["loss"] for r in rows), tot
        edges = np.linspace(0, 3 * N_PARAMS, blocks + 1).astype(int)

        def cut(it):
            import pandas as pd
            for pdf in it:
                for n, steps, loss, st in zip(pdf["n"], pdf["steps"], pdf["loss"], pdf["state"]):
                    v = np.frombuffer(st, dtype=np.float64) * n
                    yield pd.DataFrame({"block": range(blocks), "key": [st[:64]] * blocks, "n": [n] * blocks, "steps": [steps] * blocks,
                                        "loss": [loss] * blocks, "part": [v[a:b].tobytes() for a, b in zip(edges, edges[1:])]})

        def add(pdf):
            import pandas as pd
            pdf = pdf.sort_values("key")
            total = sum(np.frombuffer(x, dtype=np.float64) for x in pdf["part"])
            return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "n": [int(pdf["n"].sum())], "steps": [int(pdf["steps"].max())],
                                 "loss": [sum(pdf["loss"].tolist())], "part": [total.tobytes()]})

        sliced = outs.mapInPandas(cut, "block int, key binary, n long, steps long, loss double, part binary")
        summed = sorted(sliced.groupBy("block").applyInPandas(add, "block int, n long, steps long, loss double, part binary").collect(),
                        key=lambda r: r["block"])
        state = np.concatenate([np.frombuffer(r["part"], dtype=np.float64) for r in summed]) / summed[0]["n"]
        return state, summed[0]["steps"], summed[0]["loss"], summed[0]["n"]

    @staticmethod
    def _val_loss(va: DataFrame, flat: np.ndarray, pos_weight: float) -> float:
        bc = va.sparkSession.sparkContext.broadcast(flat)

        def part(it):
            import pandas as pd
            p = unflatten(bc.value)
            tot, n = 0.0, 0
            for pdf in it:
                z, _ = forward(p, batch_from_pandas(pdf))
                loss, _ = bce_loss_grad(z, pdf["_y"].to_numpy(), pos_weight)
                tot += float(loss.sum())
                n += len(pdf)
            yield pd.DataFrame({"loss": [tot], "n": [n]})

        r = va.mapInPandas(part, "loss double, n long").agg(F.sum("loss").alias("l"), F.sum("n").alias("n")).first()
        return r["l"] / r["n"] if r["n"] else math.inf


def prepare_features(train: DataFrame, others: list[DataFrame]):
    """F6 + F7 fitted on ``train``: sex code and standardised continuous columns."""
    enc = LabelEncoder("sex", "sex_encoded").fit(train)
    std = Standardiser().fit(train)
    return std.transform(enc.transform(train)), [std.transform(enc.transform(o)) for o in others]
