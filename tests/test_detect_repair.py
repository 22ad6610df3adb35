import random

import pytest
from pyspark.sql import functions as F

from parttrace.errors import ConfigError, GraphError, RepairError
from parttrace.operators import detect, graph, policy, repair
from parttrace.operators.components import connected


def recs(spark, data):
    return spark.createDataFrame(data, "record_id string, partition string, patient_id string, specimen_id string, slide_id string, institution_id string, label string")


@pytest.fixture(scope="module")
def sample(spark):
    return recs(spark, [("r1", "train", "p", "s1", None, "i", "a"), ("r2", "test", "p", "s2", None, "i", "b"), ("r3", "train", "q", "s2", None, "i", "a"), ("r4", "test", "z", "s9", None, None, "b"), ("r5", "train", "z2", "s8", None, None, None)])


def test_overlaps_and_policy(spark, sample):
    found = detect.identifier_overlaps(sample)
    got = {r["finding_type"]: r for r in policy.evaluate(found.findings, policy.profile()).collect()}
    assert set(got) == {"confirmed_patient_overlap", "confirmed_specimen_overlap", "institution_overlap"}
    assert got["institution_overlap"]["policy_outcome"] == "allowed_overlap" and not got["institution_overlap"]["repair_eligible"]
    assert got["confirmed_patient_overlap"]["repair_eligible"]
    strict = policy.SplitPolicy("strict", patient_disjoint=False, institution_disjoint=True)
    flipped = {r["finding_type"]: r["policy_outcome"] for r in policy.evaluate(found.findings, strict).collect()}
    assert flipped["confirmed_patient_overlap"] == "allowed_overlap" and flipped["institution_overlap"] == "violation"
    with pytest.raises(ConfigError):
        policy.profile("none")
    again = detect.identifier_overlaps(sample.orderBy(F.desc("record_id"))).findings
    assert {r[0] for r in again.select("finding_id").collect()} == {r["finding_id"] for r in got.values()}


def test_conflicts_are_left_out(spark, sample):
    bad = spark.createDataFrame([("r1", "patient_id")], "record_id string, semantic_field string")
    kinds = {r[0] for r in detect.identifier_overlaps(sample, bad).findings.select("finding_type").collect()}
    assert "confirmed_patient_overlap" not in kinds and "confirmed_specimen_overlap" in kinds


def prints(spark, data):
    return spark.createDataFrame(data, "record_id string, partition string, status string, byte_sha256 string, pixel_sha256 string, phash long, dhash long, source_image_path string, error_code string")


def test_images(spark):
    p = prints(spark, [("a", "train", "resolved", "x", "p", 0, 0, "1", None), ("b", "test", "resolved", "x", "p", 0, 0, "2", None), ("c", "test", "resolved", "y", "p", 0, 0, "3", None), ("d", "train", "resolved", "z", "o", 255, 0, "4", None), ("e", "train", "missing", None, None, None, None, "5", "missing")])
    records = p.select("record_id", "partition", *(F.lit(None).cast("string").alias(f) for f in ("patient_id", "specimen_id", "slide_id", "institution_id", "label")))
    got = sorted((r["finding_type"], r["n_records"]) for r in detect.all_findings(records, None, p).findings.collect())
    assert got == [("confirmed_byte_content_duplicate", 2), ("confirmed_pixel_content_duplicate", 3), ("image_read_error", 1), ("image_similarity_candidate", 2), ("image_similarity_candidate", 2)]
    over = [r["finding_type"] for r in detect.all_findings(records, None, p, max_pairs=3).findings.collect()]
    assert "resource_limit_exceeded" in over and "image_similarity_candidate" not in over
    assert not detect.pair_counts(p, 4).first()["limit_exceeded"]


def test_banded_equals_all_pairs(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(12)]
    near = lambda h: h ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 12)))
    sign = lambda h: h - (1 << 64) if h >> 63 else h
    p = prints(spark, [(f"r{k}", rnd.choice(["train", "test"]), "resolved", f"b{k}", f"p{k}", sign(near(rnd.choice(base))), 0, "", None) for k in range(150)])
    a = {tuple(r) for r in detect.similar(p, 8, 12, 10**6).collect()}
    assert a and a == {tuple(r) for r in detect.similar(p, 8, 12, 1).collect()}


def test_edges_and_checks(spark, sample):
    found = detect.identifier_overlaps(sample)
    e = graph.edges(found.findings, found.members)
    assert e.where("relationship_type = 'institution_overlap'").count() == 3
    assert {r[0]: r[1] for r in graph.edge_counts(found.findings).collect()}["institution_overlap"] == 3
    graph.check(found.findings, found.members, sample)
    with pytest.raises(GraphError):
        graph.check(found.findings, found.members, sample.where("record_id != 'r1'"))
    with pytest.raises(GraphError):
        graph.check(found.findings.union(found.findings), found.members, sample)
    assert graph.largest_component(found.findings, found.members) == 3


def test_components_equal_union_find(spark):
    rnd = random.Random(9)
    edges = [(f"n{rnd.randint(0, 60):02d}", f"n{rnd.randint(0, 60):02d}") for _ in range(45)]
    parent: dict[str, str] = {}

    def find(a):
        parent.setdefault(a, a)
        return a if parent[a] == a else find(parent[a])

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r[0]: r[1] for r in connected(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {n: find(n) for n in parent if n in got} and all(find(a) == a for a in parent if a not in got)
    assert connected(spark.createDataFrame([], "src string, dst string")).count() == 0


def fold(components, goal, overall, fraction, weigh):
    """The greedy rule one component after the other."""
    train, labels, side = 0, {}, {}
    for c in sorted(components, key=lambda c: (-c["size"], -c["cross"], c["root"])):
        options = []
        for k, name in enumerate(("train", "test")):
            now = train + (c["size"] if name == "train" else 0)
            own = {x: labels.get(x, 0) + (c["labels"].get(x, 0) if name == "train" else 0) for x in overall}
            dev = sum(abs(own[x] - n * fraction) for x, n in overall.items()) if weigh else 0.0
            options.append((abs(now - goal), round(dev, 9), c["n_test"] if name == "train" else c["n_train"], k, name))
        name = min(options)[-1]
        side[c["root"]] = name
        if name == "train":
            train += c["size"]
            for x, n in c["labels"].items():
                labels[x] = labels.get(x, 0) + n
    return side


@pytest.mark.parametrize("seed,missing,target", [(1, False, 0.5), (2, True, 0.5), (3, False, None), (4, False, 0.25), (5, False, 0.75)])
def test_repair_equals_fold(spark, seed, missing, target):
    rnd = random.Random(seed)
    data = [(f"r{k:02d}", rnd.choice(["train", "test"]), f"p{rnd.randint(0, 25)}", None, None, "i", None if missing and k == 3 else rnd.choice("ab")) for k in range(40)]
    df = recs(spark, data)
    found = detect.identifier_overlaps(df)
    judged = policy.evaluate(found.findings, policy.profile())
    out = repair.propose(df, judged, found.members, policy.profile(), target)
    groups: dict[str, list] = {}
    for r in data:
        groups.setdefault(r[2], []).append(r)
    comps = []
    for g in groups.values():
        crossing = len({r[1] for r in g}) == 2
        for part in [g] if crossing else [[r] for r in g]:
            labels: dict[str, int] = {}
            for r in part:
                labels[r[6] or repair.MISSING_LABEL] = labels.get(r[6] or repair.MISSING_LABEL, 0) + 1
            comps.append({"root": min(r[0] for r in part), "size": len(part), "cross": int(crossing), "labels": labels, "n_train": sum(r[1] == "train" for r in part), "n_test": sum(r[1] == "test" for r in part)})
    overall: dict[str, int] = {}
    for c in comps:
        for x, n in c["labels"].items():
            overall[x] = overall.get(x, 0) + n
    fraction = target if target is not None else sum(r[1] == "train" for r in data) / len(data)
    side = fold(comps, fraction * len(data), overall, fraction, repair.MISSING_LABEL not in overall)
    assert {r["root"]: r["proposed_partition"] for r in out.components.collect()} == side
    assert out.metrics["component_count"] == len(comps) and out.records.count() == 40
    assert "institution_overlap" in out.excluded


def test_repair_refuses(spark, sample):
    found = detect.identifier_overlaps(sample)
    judged = policy.evaluate(found.findings, policy.profile())
    with pytest.raises(RepairError):
        repair.propose(sample, judged, found.members, policy.profile(), 1.0)
    with pytest.raises(RepairError):
        repair.propose(sample.limit(0), judged, found.members, policy.profile())
    whole = repair.propose(sample, judged, found.members, policy.profile(), 0.5, by_institution=True)
    assert whole.included[-1] == "institution_overlap" and whole.metrics["largest_component_size"] == 3


def test_repair_is_complete(spark):
    """A record that is dealt to no side, or to two, fails the proposal."""

    records = spark.createDataFrame([("a",), ("b",)], "record_id string")
    dealt = lambda *rows: spark.createDataFrame(rows, "record_id string, proposed_partition string")
    repair._complete(dealt(("a", "train"), ("b", "test")), records)
    for rows in ([("a", "train")], [("a", "train"), ("b", None)], [("a", "train"), ("a", "test"), ("b", "test")], [("a", "train"), ("b", "test"), ("c", "test")]):
        with pytest.raises(RepairError):
            repair._complete(dealt(*rows), records)


def test_similar_beyond_the_limit(spark):
    """Bands on the narrower hash give the pairs that comparing all gives; two wide thresholds are refused."""

    rnd = random.Random(5)
    rows = []
    for k in range(60):
        p, d = rnd.getrandbits(63), rnd.getrandbits(63)
        for side in ("train", "test"):
            flip = sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 25)))
            rows.append((f"{side}{k}", side, "resolved", None, None, p ^ flip, d ^ (flip & 0xFFFF)))
    df = spark.createDataFrame(rows, "record_id string, partition string, status string, byte_sha256 string, pixel_sha256 string, phash long, dhash long")
    pairs = lambda most: sorted(map(tuple, detect.similar(df, 24, 6, max_pairs=most).collect()))
    assert pairs(0) == pairs(10**6) and pairs(0)
    with pytest.raises(ConfigError):
        detect.similar(df, 20, 20, max_pairs=0)
