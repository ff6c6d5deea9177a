"""A relational graph attention network over edge lists.

Messages are a join of edges with node features and a product with the edge type's weights; attention is a softmax over
each node's incoming edges; both are DataFrame steps, so the graph may be of any size. Nodes, edges and the result of each
step are settled: nothing is computed again for the next. Weights are small and travel in the plan's Arrow functions.
Training follows the whole graph's gradient. train() does so on the driver, for graphs of up to MOST_NODES and MOST_EDGES.
train_parts() sums it over parts of the graph in tasks, for graphs of any number of nodes: a part is up to PART_NODES nodes with all
from which values reach them, so a task's memory is bounded where nodes have few predecessors, as in a timetable's chain.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.tables import settle

SLOPE, HEADS, HIDDEN, LAYERS, TINY = 0.2, 4, 256, 3, 1e-12
#: Rows that an Arrow function works on at once.
SLICE = 512
#: Nodes of a part of a graph that is trained on in tasks.
PART_NODES = 4096
#: Graphs up to so large are trained on by the driver.
MOST_NODES, MOST_EDGES = 50_000, 200_000


def softmax_by_target(scores: DataFrame, keys: list[str], score_col: str = "score") -> DataFrame:
    """scores with weight: exp(score - max) over its sum by keys; the maximum is 0 at least, the sum a little more."""
    top = scores.groupBy(*keys).agg(F.greatest(F.max(score_col), F.lit(0.0)).alias("_top"))
    rows = scores.join(top, keys).withColumn("_e", F.exp(F.col(score_col) - F.col("_top")))
    sums = rows.groupBy(*keys).agg((F.sum("_e") + TINY).alias("_sum"))
    return rows.join(sums, keys).withColumn("weight", F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def aggregate_messages(nodes: DataFrame, messages: DataFrame, value_col: str = "h") -> DataFrame:
    """no, out: the sum of weight times the vector over each node's messages (dst_no, head, weight, vector); heads in order.

    Nodes without messages get null.
    """
    cells = messages.select("dst_no", "head", F.posexplode(value_col).alias("_i", "_x"), "weight")
    sums = cells.groupBy("dst_no", "head", "_i").agg(F.sum(F.col("weight") * F.col("_x")).alias("_s"))
    out = sums.groupBy("dst_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("head", "_i", "_s"))), lambda s: s["_s"]).alias("out"))  # as long as a layer is wide
    return nodes.select("no").join(out.withColumnRenamed("dst_no", "no"), "no", "left")


@dataclass
class Layer:
    """weights: (types, width, width); source and target: (heads, width / heads); gain and shift of the norm."""

    weights: np.ndarray
    source: np.ndarray
    target: np.ndarray
    gain: np.ndarray
    shift: np.ndarray


@dataclass
class Network:
    start: tuple[np.ndarray, np.ndarray]
    layers: list[Layer]
    end: tuple[np.ndarray, np.ndarray]


def _uniform(rng: np.random.Generator, rows: int, cols: int, gain: float) -> np.ndarray:
    limit = gain * np.sqrt(6 / (rows + cols))
    return rng.uniform(-limit, limit, (rows, cols))


def network(width: int, types: int, out: int, hidden: int = HIDDEN, layers: int = LAYERS, heads: int = HEADS, seed: int = 0) -> Network:
    """Weights drawn evenly by the size of each layer, from a seed."""
    if hidden % heads:
        raise ValueError("the hidden width has to be a multiple of the heads")
    rng, gain = np.random.default_rng(seed), float(np.sqrt(2 / (1 + SLOPE**2)))
    stack = []
    for _ in range(layers):
        weights = np.array([_uniform(rng, hidden, hidden, gain) for _ in range(types)])
        a, b = (_uniform(rng, heads, hidden // heads, gain) for _ in range(2))
        stack.append(Layer(weights, a, b, np.ones(hidden), np.zeros(hidden)))
    return Network((_uniform(rng, width, hidden, 1.0), np.zeros(hidden)), stack, (_uniform(rng, hidden, out, 1.0), np.zeros(out)))


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float) if n else np.zeros((0, 0))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0)), pa.array(x.ravel(), pa.float64()))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that a layer's values for them take little memory, whatever the session's batches are."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def linear(nodes: DataFrame, weight: np.ndarray, bias: np.ndarray) -> DataFrame:
    """nodes (no, x) with x times weight plus bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(_vectors(batch.column(1), batch.num_rows) @ weight + bias)], names=["no", "x"])

    return nodes.select("no", "x").mapInArrow(run, "no int, x array<double>")


def layer_forward(nodes: DataFrame, edges: DataFrame, layer: Layer) -> DataFrame:
    """no, x: one layer with its residual and norm. nodes: no, x; edges: src_no, dst_no, type_no."""
    heads, depth = layer.source.shape
    ends = edges.join(nodes.select(F.col("no").alias("src_no"), F.col("x").alias("xs")), "src_no").join(nodes.select(F.col("no").alias("dst_no"), F.col("x").alias("xd")), "dst_no")
    ends = ends.select("dst_no", "src_no", "type_no", "xs", "xd")

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n = batch.num_rows
            kinds = batch.column(2).to_numpy()
            xs, xd = _vectors(batch.column(3), n), _vectors(batch.column(4), n)
            hs, hd = np.zeros_like(xs), np.zeros_like(xd)
            for k in np.unique(kinds):
                at = kinds == k
                hs[at], hd[at] = xs[at] @ layer.weights[k], xd[at] @ layer.weights[k]
            hs, hd = hs.reshape(n, heads, depth), hd.reshape(n, heads, depth)
            score = (hs * layer.source).sum(-1) + (hd * layer.target).sum(-1)
            score = np.where(score > 0, score, SLOPE * score)
            cols = [batch.column(0).take(pa.array(np.repeat(np.arange(n), heads))), batch.column(1).take(pa.array(np.repeat(np.arange(n), heads))), pa.array(np.tile(np.arange(heads, dtype=np.int32), n)), pa.array(score.ravel()), _lists(hs.reshape(n * heads, depth))]
            yield pa.RecordBatch.from_arrays(cols, names=["dst_no", "src_no", "head", "score", "h"])

    scores = settle(ends.mapInArrow(transform, "dst_no int, src_no int, head int, score double, h array<double>"))
    out = aggregate_messages(nodes, softmax_by_target(scores, ["dst_no", "head"]))
    rows = nodes.select("no", "x").join(out, "no")

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n = batch.num_rows
            if n:
                x = _vectors(batch.column(1), n)
                more, has = np.zeros((n, heads * depth)), np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
                more[has] = _vectors(batch.column(2), len(has)) if len(has) else 0
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(normalise(x + more, layer.gain, layer.shift))], names=["no", "x"])

    return rows.select("no", "x", "out").mapInArrow(norm, "no int, x array<double>")


def normalise(x: np.ndarray, gain: np.ndarray, shift: np.ndarray) -> np.ndarray:
    middle = x.mean(axis=1, keepdims=True)
    return (x - middle) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5) * gain + shift


def forward(nodes: DataFrame, edges: DataFrame, net: Network) -> DataFrame:
    """no, x: the network's output for each node, layer by layer."""
    x, edges = settle(linear(nodes, *net.start)), settle(edges.select("src_no", "dst_no", "type_no"))
    for layer in net.layers:
        x = settle(layer_forward(x, edges, layer))
    return linear(x, *net.end)


def losses(features: DataFrame, outputs: DataFrame, edges: DataFrame) -> DataFrame:
    """reconstruction, consistency, loss: mean squares of output less feature, and of outputs across edges; the loss is the
    first plus half the second. features, outputs: no, x."""
    mean = lambda a, b: F.avg(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v) / F.size(a))
    both = features.select("no", F.col("x").alias("f")).join(outputs.select("no", F.col("x").alias("o")), "no")
    ends = edges.join(outputs.select(F.col("no").alias("src_no"), F.col("x").alias("a")), "src_no").join(outputs.select(F.col("no").alias("dst_no"), F.col("x").alias("b")), "dst_no")
    out = both.agg(mean(F.col("f"), F.col("o")).alias("reconstruction")).join(ends.agg(mean(F.col("a"), F.col("b")).alias("consistency")))  # a row each
    out = out.withColumn("consistency", F.coalesce("consistency", F.lit(0.0)))
    return out.withColumn("loss", F.col("reconstruction") + 0.5 * F.col("consistency"))


def _sums(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of values summed by their places among n."""
    out = np.zeros((n, *values.shape[1:]))
    if len(at):
        order = np.argsort(at, kind="stable")
        begins = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        out[at[order][begins]] = np.add.reduceat(values[order], begins, axis=0)
    return out


class _Forward:
    """One layer's values on the driver, kept for the way back."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, layer: Layer):
        heads, depth = layer.source.shape
        self.x, self.edges, self.layer, n = x, edges, layer, len(x)
        src, dst, kind = edges.T
        self.kinds = np.unique(kind)
        hs, hd = np.zeros((len(edges), heads * depth)), np.zeros((len(edges), heads * depth))
        for k in self.kinds:
            at = kind == k
            moved = x @ layer.weights[k]
            hs[at], hd[at] = moved[src[at]], moved[dst[at]]
        self.hs, self.hd = hs.reshape(-1, heads, depth), hd.reshape(-1, heads, depth)
        self.score = (self.hs * layer.source).sum(-1) + (self.hd * layer.target).sum(-1)
        bent = np.where(self.score > 0, self.score, SLOPE * self.score)
        top = np.zeros((n, heads))
        np.maximum.at(top, dst, bent)
        e = np.exp(bent - top[dst])
        total = _sums(n, dst, e) + TINY
        self.weight = e / total[dst]
        out = _sums(n, dst, self.weight[..., None] * self.hs)
        y = x + out.reshape(n, -1)
        self.spread = np.sqrt(y.var(axis=1, keepdims=True) + 1e-5)
        self.normed = (y - y.mean(axis=1, keepdims=True)) / self.spread
        self.out = self.normed * layer.gain + layer.shift

    def back(self, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The gradient by x, and those by weights, source, target, gain and shift."""
        layer, (src, dst, kind) = self.layer, self.edges.T
        heads, depth = layer.source.shape
        by_gain, by_shift = (g * self.normed).sum(axis=0), g.sum(axis=0)
        g = g * layer.gain
        g = (g - g.mean(axis=1, keepdims=True) - self.normed * (g * self.normed).mean(axis=1, keepdims=True)) / self.spread
        by_message = g.reshape(-1, heads, depth)[dst]
        by_weight = (by_message * self.hs).sum(-1)
        mixed = _sums(len(self.x), dst, self.weight * by_weight)
        by_score = self.weight * (by_weight - mixed[dst]) * np.where(self.score > 0, 1, SLOPE)
        by_hs = by_message * self.weight[..., None] + by_score[..., None] * layer.source
        by_hd = by_score[..., None] * layer.target
        by_x, by_weights = g.copy(), np.zeros_like(layer.weights)
        for k in self.kinds:
            at = kind == k
            moved = _sums(len(self.x), src[at], by_hs[at].reshape(-1, heads * depth)) + _sums(len(self.x), dst[at], by_hd[at].reshape(-1, heads * depth))
            by_weights[k] = self.x.T @ moved
            by_x += moved @ layer.weights[k].T
        return by_x, [by_weights, (by_score[..., None] * self.hs).sum(0), (by_score[..., None] * self.hd).sum(0), by_gain, by_shift]


def _parameters(net: Network) -> list[np.ndarray]:
    return [*net.start, *(p for l in net.layers for p in (l.weights, l.source, l.target, l.gain, l.shift)), *net.end]


def loss_and_gradients(net: Network, x: np.ndarray, edges: np.ndarray, part: tuple[np.ndarray, np.ndarray, int, int] | None = None) -> tuple[float, list[np.ndarray], np.ndarray]:
    """The loss, its gradient by each parameter, and the outputs. edges: rows (src, dst, type).

    part: where x and edges are a part of a graph, which nodes and edges count here (true or false for each), and how many
    nodes and edges the whole graph has. Losses and gradients of parts add up to those of the graph.
    """
    steps, h = [], x @ net.start[0] + net.start[1]
    for layer in net.layers:
        steps.append(_Forward(h, edges, layer))
        h = steps[-1].out
    out = h @ net.end[0] + net.end[1]
    wrong, gap = out - x, out[edges[:, 0]] - out[edges[:, 1]]
    n, m = wrong.size, gap.size
    if part is not None:
        wrong, gap = wrong * part[0][:, None], gap * part[1][:, None]
        n, m = part[2] * x.shape[1], part[3] * x.shape[1]
    loss = float((wrong**2).sum() / n + (0.5 * (gap**2).sum() / m if m else 0))
    g = 2 * wrong / n
    if len(edges) and m:
        g += _sums(len(g), edges[:, 0], gap / m) - _sums(len(g), edges[:, 1], gap / m)
    ends = [h.T @ g, g.sum(axis=0)]
    g = g @ net.end[0].T
    middle: list[np.ndarray] = []
    for step in reversed(steps):
        g, own = step.back(g)
        middle = own + middle
    return loss, [x.T @ g, g.sum(axis=0), *middle, *ends], out


class _Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.first, self.second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def follow(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, a, b in zip(self.params, grads, self.first, self.second, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            p -= self.rate * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.999**self.step)) + 1e-8)


def train(x: np.ndarray, edges: np.ndarray, types: int, hidden: int = HIDDEN, layers: int = LAYERS, heads: int = HEADS, epochs: int = 50, rate: float = 0.005, seed: int = 0) -> tuple[Network, list[float]]:
    """A network that reproduces its features while linked nodes stay alike, by Adam on the driver; the loss of each epoch.

    x: a row a node, which has to fit the driver, as a timetable's graph does; edges: rows (src, dst, type). There is no
    dropout, so a seed gives the same network. The result goes into forward(), on a graph of any size.
    """
    net = network(x.shape[1], types, x.shape[1], hidden, layers, heads, seed)
    edges = np.asarray(edges, int).reshape(-1, 3)
    adam, course = _Adam(_parameters(net), rate), []
    for _ in range(epochs):
        loss, grads, _ = loss_and_gradients(net, x, edges)
        course.append(loss)
        adam.follow(grads)
    return net, course


def _parts(nodes: DataFrame, edges: DataFrame, hops: int, part_nodes: int) -> DataFrame:
    """part, blob: each part's nodes with those from which values reach them in so many hops, and the edges between.

    An edge counts in the part of its target, so its source's output is needed there, too: a hop more.
    """
    need = settle(nodes.select(F.floor(F.col("no") / part_nodes).cast("int").alias("part"), "no", F.lit(0).alias("hop")))
    edge, step = edges.toDF("src", "no", "type"), need
    for hop in range(1, hops + 2):
        step = step.select("part", "no").join(edge.select("src", "no"), "no").select("part", F.col("src").alias("no")).distinct()
        step = settle(step.join(need, ["part", "no"], "left_anti").withColumn("hop", F.lit(hop)))
        if step.isEmpty():
            break
        need = settle(need.unionByName(step))
    x = need.join(nodes.select("no", "x"), "no").select("part", "no", "hop", "x")
    # of the outermost only the features are needed; all edges into the others are there
    links = need.filter(F.col("hop") <= hops).join(edge, "no").select("part", "src", F.col("no").alias("dst"), "type", "hop")

    def pack(key: tuple, own: pa.Table, between: pa.Table) -> pa.Table:
        own, between = own.sort_by("no"), between.sort_by([("src", "ascending"), ("dst", "ascending"), ("type", "ascending")])
        no = own["no"].to_numpy()
        links = np.array([np.searchsorted(no, between["src"].to_numpy()), np.searchsorted(no, between["dst"].to_numpy()), between["type"].to_numpy()], np.int64).T
        values = _vectors(own["x"].combine_chunks(), own.num_rows)
        blob = pickle.dumps((values, links.reshape(-1, 3), own["hop"].to_numpy() == 0, between["hop"].to_numpy() == 0))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([blob], pa.large_binary() if len(blob) > 2**31 - 1 else pa.binary())], names=["part", "blob"])

    x, links = x.toDF("part", "no", "hop", "x"), links.toDF("to_part", "src", "dst", "type", "hop")
    return x.groupBy("part").cogroup(links.groupBy("to_part")).applyInArrow(pack, "part int, blob binary")


def train_parts(nodes: DataFrame, edges: DataFrame, types: int, hidden: int = HIDDEN, layers: int = LAYERS, heads: int = HEADS, epochs: int = 50, rate: float = 0.005, seed: int = 0, part_nodes: int = 0) -> tuple[Network, list[float]]:
    """As train(), over DataFrames of any size: nodes (no from 0, x), edges (src_no, dst_no, type_no).

    Each epoch is a job in which each task sums the gradients of its parts; the driver adds one sum a task, as many as cores.
    """
    nodes, edges = settle(nodes.select("no", "x")), settle(edges.select("src_no", "dst_no", "type_no"))
    n, m, width = nodes.count(), edges.count(), nodes.select(F.max(F.size("x"))).first()[0]
    net = network(width, types, width, hidden, layers, heads, seed)
    adam, course, kinds = _Adam(_parameters(net), rate), [], [r[0] for r in edges.select("type_no").distinct().collect()]  # `types` at most
    context = nodes.sparkSession.sparkContext
    cores = context.defaultParallelism
    if not part_nodes:  # as many parts for each core
        part_nodes = max(512, -(-n // (cores * -(-n // (cores * PART_NODES)))))
    tasks = max(1, min(-(-n // part_nodes), cores))
    parts = settle(_parts(nodes, edges, layers, part_nodes).repartitionByRange(tasks, "part")).select("blob")
    for _ in range(epochs):
        sent = context.broadcast(net)  # of a fixed size

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            loss, total = 0.0, None
            for batch in batches:
                for blob in batch.column(0):
                    x, links, own, counted = pickle.loads(blob.as_py())
                    more, grads, _ = loss_and_gradients(sent.value, x, links, (own, counted, n, m))
                    loss, total = loss + more, grads if total is None else [a + b for a, b in zip(total, grads, strict=True)]
            if total is not None:
                total = [g[kinds] if g.ndim == 3 else g for g in total]  # types that no edge has stay as they are
                yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([pickle.dumps(total)], pa.binary())], names=["loss", "grads"])

        sums, loss = [np.zeros_like(p) for p in adam.params], 0.0
        for row in parts.mapInArrow(run, "loss double, grads binary").collect():  # a row a task
            loss += row.loss
            for s, g in zip(sums, pickle.loads(row.grads), strict=True):
                if s.ndim == 3:
                    s[kinds] += g
                else:
                    s += g
        course.append(loss)
        adam.follow(sums)
        sent.destroy()
    return net, course


def embed_all_nodes(nodes: DataFrame, edges: DataFrame, types: int, **options) -> DataFrame:
    """As embed_nodes(), by train_parts(): for graphs of any size."""
    nodes, edges = settle(nodes.select("no", "x")), settle(edges.select("src_no", "dst_no", "type_no"))
    return forward(nodes, edges, train_parts(nodes, edges, types, **options)[0])


def embed_nodes(nodes: DataFrame, edges: DataFrame, types: int, **options) -> DataFrame:
    """no, x: outputs of a network trained on the graph itself. nodes: no, x; edges: src_no, dst_no, type_no."""
    nodes, edges = settle(nodes.select("no", "x")), settle(edges.select("src_no", "dst_no", "type_no"))
    if nodes.count() > MOST_NODES or edges.count() > MOST_EDGES:
        raise ValueError(f"training is for graphs of up to {MOST_NODES} nodes and {MOST_EDGES} edges: train on a part, then use forward()")
    rows = nodes.orderBy("no").collect()  # MOST_NODES at most
    place = {r.no: i for i, r in enumerate(rows)}
    links = np.array([(place[r.src_no], place[r.dst_no], r.type_no) for r in edges.orderBy("src_no", "dst_no", "type_no").collect()], int)
    net, _ = train(np.array([r.x for r in rows], float), links, types, **options)
    return forward(nodes, edges, net)
