import csv
import json
import struct
import zlib

import numpy as np
import pytest

from parttrace import cli
from parttrace.errors import AssistCredentialError, AssistRequestError, AssistResponseError, AuditError, ConfigError, ManifestError, ReportError, SchemaError
from parttrace.operators import mapping
from parttrace.plans import assist, audit, report
from parttrace.sources import images, manifest


def png(rgb):
    h, w = rgb.shape[:2]
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bmp(rgb):
    h, w = rgb.shape[:2]
    pad = b"\0" * (-3 * w % 4)
    body = b"".join(rgb[y, :, ::-1].tobytes() + pad for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def picture(seed):
    return np.random.default_rng(seed).integers(0, 256, (16, 20, 3), dtype=np.uint8)


@pytest.mark.parametrize("content,fails", [(b"a,b\n1\n", False), (b"a,b\n\n1,2\n", False), (b"\xef\xbb\xbfa\r\n\"x\ny\"\r\n", False), (b"", True), (b"\na\n1\n", True), (b"a,a\n1,2\n", True), (b"a b,a-b\n1,2\n", True), (b"a\n1,2\n", True), (b'a\n"x\n', True), (b"a\n\xff\n", True), (b"a\n", True), (b"a, \n1,2\n", True)])
def test_strict_csv(content, fails):
    if fails:
        with pytest.raises(ManifestError):
            manifest.parse(content)
    else:
        headers, rows, warnings, encoding, newline = manifest.parse(content)
        assert all(len(r) == len(headers) for r in rows)
        assert encoding == ("utf-8-sig" if content.startswith(b"\xef") else "utf-8")


def test_blank_lines_are_rows():
    assert manifest.parse(b"a,b\n\n1,2\n")[1:3] == ([[None, None], ["1", "2"]], ["row 0 has fewer cells than headers"])
    assert [manifest.newline_style(x) for x in ("", "\n", "\r\n", "\r", "\n\r\n")] == ["none", "lf", "crlf", "cr", "mixed"]


def test_read_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b'id,Name\nx,"a\nb"\ny\n')
    m = manifest.read_csv(spark, str(tmp_path / "m.csv"), "train")
    assert [(r[0], *r["raw"]) for r in m.rows.orderBy("source_row_number").collect()] == [(0, "x", "a\nb"), (1, "y", None)] and m.row_count == 2
    (tmp_path / "bad.csv").write_bytes(b"a\n1,2\n")
    with pytest.raises(ManifestError):
        manifest.read_csv(spark, str(tmp_path / "bad.csv"), "train")


def test_images_decode_alike():
    rgb = picture(1)
    a, b = images.fingerprint(png(rgb)), images.fingerprint(bmp(rgb))
    assert a["status"] == b["status"] == "resolved" and a["pixel_sha256"] == b["pixel_sha256"] and (a["phash"], a["dhash"]) == (b["phash"], b["dhash"])
    near = rgb.copy()
    near[0, 0] ^= 1
    assert (images.fingerprint(png(near))["phash"] ^ a["phash"]).bit_count() <= 8
    assert images.fingerprint(b"text")["status"] == "unreadable" and images.fingerprint(b"GIF89a")["status"] == "unsupported_format"
    assert images.fingerprint(png(rgb), max_pixels=100)["error_code"] == "image_too_large"
    assert images.fingerprint(png(rgb)[:60])["status"] == "unreadable"


def test_sizes_before_decoding():
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 30, 70) + bytes(20)
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 256, 4, 1, 90) + struct.pack("<HHIHH", 257, 3, 1, 40, 0)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (79).to_bytes(3, "little") + (9).to_bytes(3, "little")
    for content, kind, size in ((jpeg, "JPEG", (70, 30)), (tiff, "TIFF", (90, 40)), (webp, "WEBP", (80, 10))):
        assert images.kind_of(content) == kind and images.size_of(content, kind) == size
        assert images.fingerprint(content, max_pixels=100)["error_code"] == "image_too_large"
        assert images.size_of(content[:13], kind) is None or kind == "WEBP"


def test_png_filters():
    """Rows under each filter decode to the pixels that they were made from."""
    rnd = np.random.default_rng(2)
    rgb = rnd.integers(0, 256, (5, 7, 3), np.uint8)
    lines = rgb.reshape(5, 21).astype(int)
    raw = b""
    for y, rule in enumerate((0, 1, 2, 3, 4)):
        up = lines[y - 1] if y else np.zeros(21, int)
        left = np.concatenate([np.zeros(3, int), lines[y][:-3]])
        corner = np.concatenate([np.zeros(3, int), up[:-3]])
        p = left + up - corner
        nearest = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        raw += bytes([rule]) + ((lines[y] - [0 * left, left, up, (left + up) // 2, nearest][rule]) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    content = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw + bytes(10**6))) + chunk(b"IEND", b"")
    assert (images.decode(content) == rgb).all()


def test_mapping(spark, tmp_path):
    df = spark.createDataFrame([(f"a{k}.png", "train", "xy"[k % 2], f"u{k}", f"p{k % 6}") for k in range(12)], "file string, split_col string, diagnosis_group string, uuid string, patient_id string")
    m = mapping.infer(df, df.columns)
    assert {k: m.columns.get(k) for k in ("image_path", "patient_id", "class_label", "source_record_id")} == {"image_path": "file", "patient_id": "patient_id", "class_label": "diagnosis_group", "source_record_id": "uuid"}
    more = df.withColumn("extra", df.file)
    assert mapping.infer(more, more.columns, {"patient_id": "EXTRA", "image_path": "file"}).columns["patient_id"] == "extra"
    with pytest.raises(SchemaError):  # a column that is given for one field and means another
        mapping.infer(df, df.columns, {"patient_id": "SPLIT_COL"})
    with pytest.raises(SchemaError):
        mapping.infer(df, df.columns, {"patient_id": "nope"})
    with pytest.raises(SchemaError):
        mapping.infer(df, df.columns, {"patient_id": "uuid", "slide_id": "uuid"})
    with pytest.raises(SchemaError):
        mapping.infer(df.select("diagnosis_group"), ["diagnosis_group"])
    (tmp_path / "m.yaml").write_text("patient_id: subject\n")
    assert mapping.load_schema_map(str(tmp_path / "m.yaml")) == {"patient_id": "subject"}
    for name, text in (("a.json", '{"label": "x"}'), ("b.json", "[]"), ("c.txt", "{}"), ("d.json", '{"patient_id": " "}'), ("e.json", "{")):
        (tmp_path / name).write_text(text)
        with pytest.raises(SchemaError):
            mapping.load_schema_map(str(tmp_path / name))


def test_assist(spark):
    df = spark.createDataFrame([("a.png", "s1", 1), ("b.png", "s2", 2)], "image_path string, code string, other int")
    sides = [manifest.from_table(df, "train"), manifest.from_table(df.withColumnRenamed("code", "Code "), "test")]
    maps = [mapping.infer(m.rows, m.headers, {"image_path": "image_path"}, require_coverage=False) for m in sides]
    maps = [mapping.Mapping({f: c if f == "image_path" else mapping.Choice() for f, c in k.choices.items()}) for k in maps]
    body = assist.request(sides, maps)
    assert "s1" not in json.dumps(body) and len(assist.request_digest(body)) == 64
    entry = lambda f, a, b, c: {"field": f, "train_column": a, "test_column": b, "confidence": c}
    asked = [entry("patient_id", "code", "code", 0.9), entry("slide_id", "x", "", 0.9), entry("image_path", "code", "code", 1), entry("label", "code", "code", 0.8), entry("specimen_id", "other", "code", 0.2), entry("patient_id", "other", "other", 0.9)]
    accepted, refused = assist.validate(asked, sides, maps)
    assert accepted == {"patient_id": ("code", "Code ", 0.9)}
    assert refused == {
        "image_path": ["protected_field"], "label": ["unsupported_field"], "patient_id": ["duplicate_field"], "slide_id": ["train_column_absent", "test_column_missing"], "specimen_id": ["test_column_reused", "low_confidence"],
    }
    got = assist.assist(sides, maps, lambda body: asked)
    assert [k.columns["patient_id"] for k in got] == ["code", "Code "] and got[0].choices["patient_id"].source == "assisted"

    class AuthFailed(Exception):
        pass

    def refuse(body):
        raise AuthFailed

    assert assist.assist(sides, maps, refuse) == maps and "credentials" in maps[0].messages[-1]
    bare = [mapping.Mapping({f: mapping.Choice() for f in k.choices}) for k in maps]
    for client, kind in ((refuse, AssistCredentialError), (lambda b: [], AssistResponseError), (lambda b: 1 / 0, AssistRequestError)):
        with pytest.raises(kind):
            assist.assist(sides, bare, client)


def test_credentials():
    from parttrace.plans.credentials import resolve

    quiet = {"person": True, "say": lambda s: None}
    assert resolve(False, False).source == "not_requested"
    assert resolve(True, True, environment={"OPENAI_API_KEY": "k"}).available
    assert resolve(True, False, environment={}, person=False).stop and not resolve(True, True, environment={}, person=False).stop
    env: dict[str, str] = {}
    answers = iter(["?", "o", "y", "p", "p"])
    keys = iter([" ", "secret"])
    got = resolve(True, False, page="http://p", environment=env, read=lambda q: next(answers), read_secret=lambda q: next(keys), show_page=lambda p: True, **quiet)
    assert got.available and got.page_opened and env == {"OPENAI_API_KEY": "secret"} and "secret" not in repr(got)
    assert resolve(True, False, environment={}, read=lambda q: "c", **quiet).source == "declined"
    assert resolve(True, True, environment={}, read=lambda q: "q", **quiet).stop and resolve(True, True, environment={}, read=lambda q: "x", **quiet).stop


def test_pair_messages(spark):
    one = mapping.Mapping({"image_path": mapping.Choice("Img", "command_line", 1.0), "patient_id": mapping.Choice("p", "deterministic", 0.9), "slide_id": mapping.Choice()})
    two = mapping.Mapping({"image_path": mapping.Choice(), "patient_id": mapping.Choice("p", "deterministic", 0.9), "slide_id": mapping.Choice("p", "deterministic", 0.9)})
    for m in (one, two):
        m.choices |= {f: mapping.Choice() for f in mapping.FIELDS if f not in m.choices}
    said = mapping.pair_messages(one, two)
    assert any("one side only" in s for s in said) and any("given for train only" in s for s in said) and any("only train has" in s for s in said) and any("serves patient_id and slide_id" in s for s in said)


def test_manifest_paths(spark, tmp_path):
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "m.csv").write_text("a\n1\n")
    for path in ("missing.csv", "folder"):
        with pytest.raises(ManifestError):
            manifest.read_csv(spark, str(tmp_path / path), "train")
    (tmp_path / "one.csv").write_text("a\n1\n")
    (tmp_path / "two.csv").hardlink_to(tmp_path / "one.csv")
    with pytest.raises(ConfigError):
        audit.Config(str(tmp_path / "one.csv"), str(tmp_path / "two.csv"), "o")
    assert cli.main(["audit", "--train", str(tmp_path / "no.csv"), "--test", str(tmp_path / "one.csv"), "--output", str(tmp_path / "o")]) == 1


@pytest.fixture
def manifests(tmp_path):
    head = "record_uuid,image_name,subject,specimen,slide,source_center,synthetic_group\n"
    one, two = picture(1), picture(2)
    folder = tmp_path / "img"
    folder.mkdir()
    near = two.copy()
    near[3, 3] ^= 1
    for name, content in (("a.png", png(one)), ("b.png", png(one)), ("c.bmp", bmp(one)), ("d.png", png(two)), ("e.png", png(near))):
        (folder / name).write_bytes(content)
    (tmp_path / "secret.png").write_bytes(png(one))
    (folder / "link.png").symlink_to(tmp_path / "secret.png")
    (tmp_path / "train.csv").write_text(head + "t1,a.png,P1,S1,L1,C,g\nt2,d.png,P2,S2,L2,C,h\nt3,missing.png,P3,S3,L3,D,g\n")
    (tmp_path / "test.csv").write_text(head + "e1,b.png,p1,S9,L9,C,g\ne2,c.bmp,P9,S2,L8,C,h\ne3,e.png,P8,S8,l3,E,h\ne4,../x.png,P7,S7,L7,E,h\n")
    (tmp_path / "map.json").write_text(json.dumps({"source_record_id": "record_uuid", "image_path": "image_name", "patient_id": "subject", "specimen_id": "specimen", "slide_id": "slide", "institution_id": "source_center", "class_label": "synthetic_group"}))
    return tmp_path


def test_audit(spark, manifests):
    config = audit.Config(str(manifests / "train.csv"), str(manifests / "test.csv"), str(manifests / "out"), str(manifests / "img"), repair=True, schema_map=str(manifests / "map.json"))
    got = audit.run(spark, config)
    kinds = got.report["summary"]["findings_by_type"]
    assert got.exit_code == 2 and kinds == {"confirmed_patient_overlap": 1, "confirmed_specimen_overlap": 1, "confirmed_slide_overlap": 1, "institution_overlap": 1, "confirmed_byte_content_duplicate": 1, "confirmed_pixel_content_duplicate": 1, "image_similarity_candidate": 1, "image_read_error": 2}
    assert sorted(p.name for p in (manifests / "out").iterdir()) == sorted(report.NAMES)
    assert len((manifests / "out" / "repair_proposal.csv").read_text().splitlines()) == 8
    assert json.loads((manifests / "out" / "report.json").read_text())["summary"]["train_records"] == 3
    assert len(audit.summary_lines(got)) > 10
    summary = got.report["summary"]
    assert (summary["train_records"], summary["test_records"], summary["patient_overlap_findings"], summary["image_input_quality_findings"], summary["policy_violations"], summary["moved_records"]) == (3, 4, 1, 2, 5, got.report["repair"]["metrics"]["records_moved"])
    written = json.loads((manifests / "out" / "report.json").read_text())
    assert [f["finding_id"] for f in written["findings"]] == sorted(r["finding_id"] for r in got.findings.collect())
    with open(manifests / "out" / "findings.csv", newline="") as f:
        rows = list(csv.DictReader(f))
    assert tuple(rows[0]) == report.FINDING_COLUMNS and len(rows) == 9
    by = {r["finding_type"]: r for r in rows}
    patient = by["confirmed_patient_overlap"]
    assert (patient["matched_field"], patient["matched_value"], patient["evidence_count"], patient["detector_name"], patient["partitions"]) == ("patient_id", "p1", "2", "identifier_overlap", "test;train")
    assert by["confirmed_byte_content_duplicate"]["matched_value"] == "" and by["confirmed_byte_content_duplicate"]["matched_field"] == "image_path" and not patient["created_at"].startswith("2026-01-01T00")
    proof = {(r["finding_id"], r["record_id"]): r for r in got.evidence.collect()}
    assert len(proof) == sum(int(r["evidence_count"]) for r in rows) and {r["source_manifest_id"] for r in proof.values()} == {"manifest_train", "manifest_test"}
    assert all(proof[by["confirmed_byte_content_duplicate"]["finding_id"], i]["byte_sha256"] for i in by["confirmed_byte_content_duplicate"]["record_ids"].split(";"))
    with open(manifests / "out" / "repair_proposal.csv", newline="") as f:
        rows = list(csv.DictReader(f))
    assert tuple(rows[0]) == report.REPAIR_COLUMNS and {r["proposal_statement"] for r in rows} == {"A proposal for review; no data were moved."}
    tied = [r for r in rows if patient["finding_id"] in r["confirming_finding_ids"].split(";")]
    assert set(patient["record_ids"].split(";")) <= {r["record_id"] for r in tied} and len({r["component_id"] for r in tied}) == 1
    with pytest.raises(ReportError):
        audit.run(spark, config)
    with pytest.raises(ConfigError):
        audit.Config("a", "a", "o")


def test_links_out_of_the_root(spark, manifests):
    rec = spark.createDataFrame([("a", "train", "m", 0, "link.png"), ("b", "test", "m", 1, "a.png")], "record_id string, partition string, manifest_id string, source_row_number int, image_path string")
    got = {r["record_id"]: r for r in images.fingerprints(rec, str(manifests / "img")).collect()}
    assert got["a"]["status"] == "outside_root" and got["a"]["byte_sha256"] is None and got["b"]["status"] == "resolved"


def test_page_escapes():
    r = {"status": "<x>", "exit_code": 0, "summary": {}}
    assert "<x>" not in "".join(report.page(r, [dict.fromkeys(report.FINDING_COLUMNS, "<x>")]))


def test_ci_options():
    options, fail = cli.ci_options({"INPUT_TRAIN": "a", "INPUT_TEST": "b", "INPUT_OUTPUT": "o", "INPUT_REPAIR": "yes", "INPUT_FAIL_ON_VIOLATIONS": "off", "INPUT_MAX_IMAGE_PAIRS": "5"})
    assert options["repair"] and not fail and cli.config_of(options).max_image_pairs == 5
    for bad in ({"INPUT_TRAIN": "a"}, {"INPUT_TRAIN": "a", "INPUT_TEST": "b", "INPUT_OUTPUT": "o", "INPUT_REPAIR": "maybe"}):
        with pytest.raises(AuditError):
            cli.ci_options(bad)
    assert cli.main(["audit", "--train", "x", "--test", "x", "--output", "o"]) == 1
    with pytest.raises(AuditError):
        cli.step_output("a", "b\nc=d")
    assert "<b>" not in cli._escaped("<b>|`x`") and "|" not in cli._escaped("a|b")


def test_ci(spark, manifests, monkeypatch):
    """Inputs from a file, outputs of the step, and the escaped summary."""
    monkeypatch.setattr(cli, "session", lambda: spark)
    given = {"train": str(manifests / "train.csv"), "test": str(manifests / "test.csv"), "output": str(manifests / "o|ut"), "schema-map": str(manifests / "map.json"), "fail-on-violations": "false"}
    (manifests / "in.json").write_text(json.dumps(given))
    env = {"GITHUB_OUTPUT": str(manifests / "outputs"), "GITHUB_STEP_SUMMARY": str(manifests / "summary.md")}
    assert cli.ci(env, str(manifests / "in.json")) == 0
    said = dict(line.split("=", 1) for line in (manifests / "outputs").read_text().splitlines())
    assert said["status"] == "violations" and said["exit-code"] == "2" and said["violation-count"] == "3" and said["repair-proposal-csv"] == "" and said["report-json"].endswith("report.json")
    assert "o&#124;ut" in (manifests / "summary.md").read_text()
    for bad in ("[]", "{", '{"train": 1}'):
        (manifests / "bad.json").write_text(bad)
        with pytest.raises(AuditError):
            cli.ci_inputs(str(manifests / "bad.json"))


def test_streaming(spark, tmp_path):
    from parttrace.streaming.overlap import overlaps

    schema = "record_id string, partition string, patient_id string, specimen_id string, slide_id string, institution_id string"
    for k, rows in enumerate(([("a", "train", "p", None, None, None)], [("b", "test", "p", None, None, None), ("c", "test", "q", None, None, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = overlaps(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("seen").collect()] == [("patient_id", "p", 1, 1)]
