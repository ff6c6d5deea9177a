"""Every registered query: its rows are those of its SQL, or those of plain arrays."""

import hashlib
import re

import numpy as np
import pytest

from storyloom.operators import consolidate, graph
from storyloom.plans import oracle, registry

from .compare import SF, compare

QUERIES, SQL = registry.queries(), oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, name):
    assert compare(spark, QUERIES[name], SQL[name]) > 0


def _outputs(net, x, edges):
    return graph.loss_and_gradients(net, x, edges)[2]


def test_only_the_network_has_no_sql():
    assert set(QUERIES) - set(SQL) == {"rgat_forward", "rgat_train"}


def test_the_drawn_network_is_that_of_plain_arrays(spark):
    nodes, edges = registry._ring(spark, SF)
    rows = nodes.orderBy("no").collect()
    x = np.array([r.x for r in rows])
    place = {r.no: i for i, r in enumerate(rows)}
    links = np.array([(place[r.src_no], place[r.dst_no], r.type_no) for r in edges.collect()])
    net = graph.network(64, len(consolidate.EDGE_TYPES), 8)
    h = x @ net.start[0] + net.start[1]
    for layer in net.layers:
        h = graph._Forward(h, links, layer).out
    want = h @ net.end[0] + net.end[1]
    got = {r.no: r.x for r in QUERIES["rgat_forward"](spark, SF).collect()}
    assert len(got) == len(rows) and all(np.allclose(got[r.no], want[i], atol=2e-6) for i, r in enumerate(rows))


def test_the_trained_network_is_that_of_plain_arrays(spark):
    """Macro-events in the order of the timetable, bags of 300 buckets by Python's own digest, a chain, the defaults."""
    macro = sorted(QUERIES["macro_events"](spark, SF).collect(), key=lambda r: r.chronology_index)
    x = np.zeros((len(macro), 384))
    for i, r in enumerate(macro):
        for w in re.findall(r"\w+", r.text.lower()):
            b = int(hashlib.md5(w.encode()).hexdigest(), 16) % 300
            x[i, b] += 1 if b % 4 >= 2 else -1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = np.array([(i, i + 1, consolidate.EDGE_TYPES.index("BEFORE")) for i in range(len(macro) - 1)])
    net, course = graph.train(x, links, len(consolidate.EDGE_TYPES))
    assert course[-1] < course[0] and len(course) == 50 and len(net.layers) == 3 and net.layers[0].gain.shape == (256,)
    want = _outputs(net, x, links)
    got = {r.no: r.x for r in QUERIES["rgat_train"](spark, SF).collect()}
    assert set(got) == set(range(len(macro))) and all(np.allclose(got[i], want[i], atol=1e-6) for i in got)
