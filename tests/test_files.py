"""File-tree operators on small trees built in a temporary folder."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from filelake import settings
from filelake.functions import columns as C
from filelake.operators import actions, checkpoint, cleanup, gates, placement, reports
from filelake.operators.control import Control
from filelake.plans import scan
from filelake.plans.scan import OWNERS, listing, run_scan
from filelake.sources import content, filetree
from filelake.sources.content import sniff
from filelake.streaming.incremental import append_events, arrivals, claim_stream, per_second, read_claims
from tests.media import jpeg_image, movie, png_image, segment


def jpeg(seed: int, size: int = 20_000) -> bytes:
    """A small image that decodes, as large as asked by its comment."""
    return jpeg_image(1, 8, 8, note=bytes([seed]) * size)


def put(root, name: str, data: bytes) -> str:
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


@pytest.fixture
def tree(tmp_path):
    src = str(tmp_path / "src")
    for k in range(5):
        put(src, f"d{k}/a.jpg", jpeg(k))
    put(src, "x/copy.jpg", jpeg(1))
    put(src, "x/empty.jpg", b"")
    put(src, "x/small.jpg", b"\xff\xd8\xff" + b"0" * 50)
    put(src, "x/broken.mp4", b"plain text " * 20_000)
    put(src, "Thumbs.db", b"1")
    put(src, ".hidden/_x.pdf", b"%PDF")
    return src, str(tmp_path / "dst")


def test_listing_sees_hidden_and_empty_files(spark, tree):
    rows = listing(spark, tree[0]).where("kind = 'file'").collect()
    assert len(rows) == 11 and {r.size for r in rows if r.path.endswith("empty.jpg")} == {0}
    assert listing(spark, tree[0] + "/nowhere").count() == 0


def test_scan_and_rerun(spark, tree):
    src, dst = tree
    os.makedirs(dst)
    out, owners, cache, completed = run_scan(spark, src, dst, spark.createDataFrame([], OWNERS))
    assert completed and cache.count() == 6
    kinds = {(r.outcome, r.reason): r.n for r in out.groupBy("outcome", F.regexp_extract("reason", "^[A-Z_]{2,}|^Unreadable", 0).alias("reason")).agg(F.count("*").alias("n")).collect()}
    assert kinds[("TRANSFERRED", None)] == 5 and kinds[("DUPLICATE", None)] == 1 and kinds[("FAILED", "Unreadable")] == 1
    assert kinds[("SKIPPED", "EMPTY_FILE")] == kinds[("SKIPPED", "SMALL_FILE")] == kinds[("SKIPPED", "IGNORE_RULE_MATCHED")] == 1
    names = sorted(r.path.rsplit("/", 1)[1] for r in listing(spark, dst).where("kind = 'file'").collect())
    assert names == ["a(1).jpg", "a(2).jpg", "a(3).jpg", "a(4).jpg", "a.jpg"]
    again = run_scan(spark, src, dst, owners).outcomes
    assert again.where("outcome = 'PRESENT'").count() == 5 and again.where("outcome = 'TRANSFERRED'").count() == 0
    assert listing(spark, dst).where("kind = 'file'").count() == 5


def files_of(root) -> dict[str, bytes]:
    out = {}
    for folder, _, names in os.walk(root):
        for n in names:
            with open(os.path.join(folder, n), "rb") as f:
                out[os.path.relpath(os.path.join(folder, n), root)] = f.read()
    return out


@pytest.mark.parametrize("move", [False, True])
def test_literal_suffix_names_lose_no_file(spark, tmp_path, move):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    want = [jpeg(k) for k in range(5)]
    for name, data in zip(("d0/a.jpg", "d1/a.jpg", "d2/a(1).jpg", "d3/a(1).jpg", "d4/a.jpg"), want, strict=True):
        put(src, name, data)
    out = run_scan(spark, src, dst, spark.createDataFrame([], OWNERS), move=move).outcomes
    assert out.where("outcome = 'TRANSFERRED'").count() == 5 and sorted(files_of(dst).values()) == sorted(want)
    assert sorted(os.path.basename(n) for n in files_of(dst)) == ["a(1)(1).jpg", "a(1).jpg", "a(2).jpg", "a(3).jpg", "a.jpg"]
    assert len(files_of(src)) == (0 if move else 5)


def test_numbered_names_are_distinct_and_first_free(spark):
    import random

    rnd = random.Random(2)
    names = ["a.jpg", "a(1).jpg", "a(2).jpg", "a(02).jpg", "b", "b(1)", ".c", "a.b.jpg", "a(1)(1).jpg", "a[(1).jpg"]
    held = {("d", n) for n in ("a.jpg", "a(2).jpg", "a(3).jpg", "b(2)", "A(1).jpg")} | {("e", "a(1).jpg")}
    rows = [(rnd.choice("de"), rnd.choice(names), f"p{k:04d}") for k in range(300)]
    incoming, there = spark.createDataFrame(rows, "dir string, name string, path string"), spark.createDataFrame(sorted(held), "dir string, name string")
    got = {r.path: (r.dir, r.final_name) for r in placement.place(incoming, there).collect()}
    assert len(set(got.values())) == 300 and not set(got.values()) & held
    taken, want = held | {r[:2] for r in rows}, {}
    for folder, name, path in sorted(rows, key=lambda r: r[2]):
        if (folder, name) not in held and (folder, name) not in want.values():
            want[path] = (folder, name)
            continue
        stem, dot, ext = name.rpartition(".") if name.rfind(".") > 0 else (name, "", "")
        n = next(n for n in range(1, 999) if (folder, f"{stem}({n}){dot}{ext}") not in taken and (folder, f"{stem}({n}){dot}{ext}") not in want.values())
        want[path] = (folder, f"{stem}({n}){dot}{ext}")
    assert got == want


def test_transfer_never_replaces_another_file(tmp_path):
    a, b = put(tmp_path, "a", b"one"), put(tmp_path, "b", b"two")
    for move in (False, True):
        status, error = actions.transfer_one(a, b, move)[2::2]
        assert status == "FAILED" and error.startswith("FileExistsError: ") and files_of(tmp_path) == {"a": b"one", "b": b"two"}
    assert actions.transfer_one(a, f"{tmp_path}/x/c", False)[2] == actions.transfer_one(a, f"{tmp_path}/x/c", True)[2] == "TRANSFERRED"  # a second attempt finds its copy
    assert files_of(tmp_path) == {"b": b"two", "x/c": b"one"} and actions.transfer_one(a, f"{tmp_path}/x/c", True)[2] == "TRANSFERRED"
    assert actions.transfer_one(a, f"{tmp_path}/y", False)[2] == "FAILED"


def test_two_rows_with_one_destination_stop_before_any_action(spark):
    with pytest.raises(ValueError):
        actions.require_distinct(spark.createDataFrame([("a", "x"), ("b", "x")], "path string, destination string"))


@pytest.mark.parametrize(("policy", "twin"), [("SKIP", None), ("MOVE_TO_BUCKET", "_duplicates/b.jpg"), ("KEEP_BOTH", "b_DUP_1.jpg")])
def test_duplicate_policies(spark, tmp_path, policy, twin):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    put(src, "a.jpg", jpeg(1)), put(src, "b.jpg", jpeg(1))
    s = settings.Settings(duplicate_policy=policy)
    out = run_scan(spark, src, dst, spark.createDataFrame([], OWNERS), move=True, **scan.from_settings(s)).outcomes
    assert sorted(r.outcome for r in out.collect()) == ["DUPLICATE", "TRANSFERRED"] and list(files_of(src)) == ["b.jpg"]
    assert len(files_of(dst)) == 1 + bool(twin) and (not twin or any(n.endswith(twin) for n in files_of(dst)))


def test_rerun_opens_no_cached_file(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    paths = [put(src, f"{k}.jpg", jpeg(k)) for k in range(4)]
    first = run_scan(spark, src, dst, spark.createDataFrame([], OWNERS))
    stamp = os.stat(paths[0])
    with open(paths[0], "r+b") as f:
        f.write(b"\0" * 9)  # same size and time: only a reader would notice
    os.utime(paths[0], ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    put(src, "1.jpg", jpeg(9, 30_000))
    again = run_scan(spark, src, dst, first.owners, cache=first.cache)
    assert sorted(r.outcome for r in again.outcomes.collect()) == ["PRESENT"] * 3 + ["TRANSFERRED"] and again.cache.count() == 4
    assert {r.path: r.sha256 for r in again.cache.collect()}[paths[0]] == {r.path: r.sha256 for r in first.cache.collect()}[paths[0]]


def test_stop_and_resume(spark, tmp_path):
    src, dst, control = str(tmp_path / "src"), str(tmp_path / "dst"), Control(f"{tmp_path}/c/state", poll=0.01)
    for k in range(5):
        put(src, f"{k}.jpg", jpeg(k))
    asked = []

    class Second(Control):
        def go_on(self) -> bool:
            asked.append(1)
            if len(asked) == 2:
                self.stop()
            return super().go_on()

    part = run_scan(spark, src, dst, spark.createDataFrame([], OWNERS), control=Second(f"{tmp_path}/c/state"), wave=2, snapshot=f"{tmp_path}/c/s.json")
    assert not part.completed and len(files_of(dst)) == 2 and part.owners.count() == 2
    state = checkpoint.import_state(f"{tmp_path}/c/s.json")
    assert state["status"] == "STOPPED" and state["processedFiles"] == 2
    control.resume()
    done = run_scan(spark, src, dst, part.owners, control=control, wave=2, cache=part.cache)
    assert done.completed and len(files_of(dst)) == 5 and done.outcomes.where("outcome = 'PRESENT'").count() == 2
    control.pause()
    import threading

    threading.Timer(0.1, control.resume).start()
    assert control.go_on() and control.state == "RUNNING"
    with pytest.raises(ValueError):
        control.set("ODD")


def test_snapshot_is_due_by_files_or_seconds():
    t = checkpoint.Trigger(10, 60)
    assert [t.due(*x) for x in ((4, 0), (5, 1), (1, 2), (1, 3), (1, 62), (1, 63))] == [False, False, True, False, True, False]


def test_listing_in_parts(spark, tmp_path, monkeypatch):
    for k in range(40):
        put(tmp_path, f"flat/{k}", b"x")
        put(tmp_path, f"a/b/c{k % 7}/d{k}/f", b"x")
    os.symlink(str(tmp_path / "a"), str(tmp_path / "flat/link"))
    for limits in ((2, 20_000), (12, 7), (500, 3)):
        monkeypatch.setattr(filetree, "PARTS", limits[0])
        monkeypatch.setattr(filetree, "FLAT", limits[1])
        reader = filetree._Reader(str(tmp_path), False)
        rows = sorted(r[2] for p in reader.partitions() for r in reader.read(p))
        assert rows == sorted(os.path.relpath(os.path.join(d, n), tmp_path) for d, ds, fs in os.walk(tmp_path) for n in ds + fs)
    follow = filetree._Reader(str(tmp_path), True)
    assert sum(r[2].endswith("/f") for p in follow.partitions() for r in follow.read(p)) == 40  # each real folder once
    assert [r for p in reader.partitions() for r in filetree._Reader(str(tmp_path), False, str(tmp_path / "a")).read(p)] == []
    one = [r for p in reader.partitions() for r in reader.read(p) if r[2] == "flat/3"][0]
    assert one[6] is None or abs((one[6] - one[5]).total_seconds()) < 60
    os.utime(tmp_path / "flat/3", (10**9, 10**9))
    one = [r for p in reader.partitions() for r in reader.read(p) if r[2] == "flat/3"][0]
    assert one[5].year == 2001 and (one[6] is None or one[6].year > 2001)


def test_delete_while_scanning_and_prune(spark, tmp_path):
    root = str(tmp_path / "r")
    put(root, "a/x.zip", b"PK\x05\x06" + bytes(18)), put(root, "a/b/y.TXT", b"text"), put(root, "a/p.jpg", jpeg(1)), put(root, "q.pdf", b"%PDF-1"), put(root, "a/z.exe", jpeg(2))
    os.makedirs(f"{root}/e/f/g")
    files = listing(spark, root).where("kind = 'file'")
    rows = actions.delete_while_scanning(files, root, ["ARCHIVE"], ["*.txt", "exe"]).collect()
    assert {os.path.basename(r.path): r.status for r in rows} == {"x.zip": "DELETED", "y.TXT": "DELETED", "p.jpg": "KEPT", "q.pdf": "KEPT", "z.exe": "SKIPPED_REVERIFY"}
    done = spark.createDataFrame(rows, actions.RESULT)
    assert actions.running_totals(done).first().asDict() == {"examined": 5, "deleted": 2, "bytes_deleted": 26, "failed": 0, "completed": True}
    assert [tuple(r) for r in actions.deleted_per_group(done).collect()] == [("Archives", 1), ("Documents", 1)]
    stop = put(tmp_path, "stop", b"")
    assert {r.status for r in actions.delete_while_scanning(files, root, ["DOCUMENT"], [], cancel=stop).collect()} == {"NOT_REACHED"} and os.path.exists(f"{root}/q.pdf")
    for bad in ((root, ["PROTECTED_MEDIA"]), ("/etc", ["ARCHIVE"])):
        with pytest.raises(ValueError):
            actions.delete_while_scanning(files, *bad, [])
    rows = listing(spark, root)
    dirs = cleanup.empty_directories(rows.where("kind = 'dir'").select("path"), rows.where("kind = 'file'").select("path"))
    gone = {os.path.relpath(r.path, root): r.status for r in actions.prune(spark, root, dirs).collect()}
    assert gone == {"a/b": "PRUNED", "e": "PRUNED", "e/f": "PRUNED", "e/f/g": "PRUNED"} and sorted(os.listdir(root)) == ["a", "q.pdf"]
    plan = spark.createDataFrame([(f"{root}/q.pdf", "DOCUMENT"), (f"{root}/a/p.jpg", "DOCUMENT"), (f"{root}/none", "DOCUMENT")], "path string, group string")
    got = {os.path.basename(r.path): (r.status, r.error) for r in actions.delete(plan).collect()}
    assert got == {"q.pdf": ("DELETED", None), "p.jpg": ("SKIPPED_REVERIFY", "now PROTECTED_MEDIA"), "none": ("SKIPPED_REVERIFY", "no longer exists")}


def test_structures(tmp_path):
    see = lambda name, data, deep=True: content.inspect(put(tmp_path, name, bytes(data)), deep)[3:5]
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"!\xf9\x04" + bytes(4) + b"\0" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02ab\0;"
    assert see("ok.gif", gif)[1] is None and see("cut.gif", gif[:-3])[1] == "truncated GIF"
    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 10, 10, 1, 24, 0, 0, 0, 0, 0, 0) + bytes(320)
    assert see("ok.bmp", bmp)[1] is None and see("cut.bmp", bmp[:-1])[1] == "truncated BMP"
    tiff = b"II*\0" + struct.pack("<IH", 8, 1) + bytes(12 + 4)
    assert see("ok.tif", tiff)[1] is None and see("cut.tif", tiff[:15])[1] == "truncated TIFF"
    webp = b"RIFF" + struct.pack("<I", 104) + b"WEBP" + b"VP8 " + struct.pack("<I", 92) + bytes(92)
    assert see("ok.webp", webp)[1] is None and see("cut.webp", webp[:-1])[1] == "truncated RIFF"


def test_apk_and_embedded_dates(tmp_path):
    import zipfile

    for name, names in (("a.jpg", ["AndroidManifest.xml", "classes.dex"]), ("b.apk", ["x"])):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n in names:
                z.writestr(n, "x")
    assert [content.inspect(str(tmp_path / n))[3] for n in ("a.jpg", "b.apk")] == ["application/vnd.android.package-archive", "application/zip"]
    date = b"2012:03:04 05:06:07\0"
    ifd = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">HHHIII", 1, 0x8769, 4, 1, 26, 0) + struct.pack(">HHHIII", 1, 0x9003, 2, 20, 44, 0) + date
    exif = b"Exif\0\0" + ifd
    photo = jpeg_image(1, extra=segment(0xE1, exif)) + b"video Exif\0\0 behind it"
    got = content.inspect(put(tmp_path, "p.jpg", photo))
    assert got[4] is None and str(got[5]) == "2012-03-04 05:06:07"


def test_skip_events(spark):
    rows = spark.createDataFrame([("d/a", "FAILED", " ", None, None), ("d/b", "SKIPPED", None, 3, None), ("d/c", "DUPLICATE", None, 4, "d/x"), ("d/e", "TRANSFERRED", None, 4, None)], "path string, outcome string, reason string, size long, matched_path string")
    rows = rows.withColumns({"sha256": F.lit("s"), "destination_path": F.lit(None).cast("string")})
    got = {r.file_name: (r.reason, r.file_size, r.matched_path) for r in gates.skip_events(rows, "J").collect()}
    assert got == {"a": ("Unspecified failure", 0, None), "b": ("UNKNOWN", 3, None), "c": (None, 4, "d/x")}


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    assert val(C.human_bytes(F.lit(1536))) == "1.5 KB" and val(C.normalise_extension(F.lit(" *.JPG "))) == "jpg"
    assert val(C.numbered(F.lit("IMG.001.jpg"), F.lit(2))) == "IMG.001(2).jpg" and val(C.numbered(F.lit("myfile"), F.lit(1))) == "myfile(1)"
    assert val(C.mime_group(F.lit("Text/Plain; charset=x"))) == "DOCUMENT" and val(C.mime_group(F.lit(None).cast("string"))) == "OTHER"
    assert val(C.ignored(F.lit("._a"), ["._*"])) and not val(C.ignored(F.lit("a.tmp"), [".tmp"]))
    assert val(C.corrupted(F.lit("Bogus marker")))


def test_sniff_and_roots(tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 0) + b"IEND" + struct.pack(">I", zlib.crc32(b"IEND"))
    assert sniff(png) == "image/png" and sniff(b"MZ..") == "application/x-msdownload" and sniff(b"") == "application/x-empty"
    assert cleanup.dangerous_root("/") and cleanup.dangerous_root("/etc/x") and not cleanup.dangerous_root(str(tmp_path))
    with pytest.raises(ValueError):
        cleanup.check_job_paths("/a", "/a/b")


def test_report_is_capped_and_says_so(spark, tmp_path):
    import json

    ev = spark.range(30).select(F.lit("J").alias("job_id"), F.lit("SKIPPED").alias("outcome"), F.col("id").alias("event_seq"), F.lit('a"\\é\n').alias("file_path"), F.lit(2).alias("file_size"))
    path = str(tmp_path / "r.json")
    assert reports.write_outcome_report(ev, "SKIPPED", "J", path, cap=10) == 30
    got = json.load(open(path, encoding="utf-8"))
    assert "10" in got["truncationNotice"] and got["generatedAt"].endswith("Z") and {"sourcePath", "targetPath"} <= got.keys() and set(got["entries"][0]) == {"filePath", "fileSize"}
    assert got["truncated"] and got["entriesOmitted"] == 20 and len(got["entries"]) == 10 and got["totalBytes"] == 60


def test_claims_stream_over_batches(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    for k, rows in enumerate([[("b", "h1"), ("a", "h1")], [("0", "h1"), ("c", "h2")]]):
        spark.createDataFrame(rows, "path string, sha256 string").coalesce(1).write.mode("append").parquet(src)
        claim_stream(spark.readStream.schema("path string, sha256 string").parquet(src), store, str(tmp_path / "cp")).awaitTermination(60)
    got = {(r.path, r.disposition, r.matched) for r in read_claims(spark, store).collect()}
    assert got == {("a", "CLAIM", "a"), ("b", "DUPLICATE", "a"), ("0", "DUPLICATE", "a"), ("c", "CLAIM", "c")}


def test_event_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame([("J1", f"2024-01-01 00:00:0{k}", 5), ("J2", f"2024-01-01 00:00:0{k}", 7)], "job_id string, ts string, file_size long").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
    schema = "job_id string, ts timestamp, file_size long"
    q = append_events(arrivals(spark, src, schema, 1), out, str(tmp_path / "cp"), 0)
    q.processAllAvailable()
    assert len(q.recentProgress) >= 3  # one file at a time
    q.stop()
    assert spark.read.parquet(out).groupBy("job_id").agg(F.sum("file_size")).orderBy("job_id").collect() == [("J1", 15), ("J2", 21)]
    late = per_second(arrivals(spark, src, schema)).writeStream.outputMode("complete").format("memory").queryName("per_second").trigger(availableNow=True).start()
    late.awaitTermination(60)
    assert [(r.files, r.bytes) for r in spark.table("per_second").orderBy("sample_at").collect()] == [(2, 12)] * 3


def test_preview_names_the_rest(spark):
    rows = spark.range(25).select(F.format_string("f%02d", "id").alias("path"))
    assert reports.preview(rows, "path").splitlines()[::20] == ["f00", "... and 5 more"] and reports.preview(rows.limit(1), "path") == "f00\n"


def test_large_files_are_inspected_whole(tmp_path, monkeypatch):
    import random

    big, rnd = 9 << 20, random.Random(1)
    png = png_image([b"\0" + rnd.randbytes(1 << 20) for _ in range(9)], 1 << 20, 9, parts=4)
    hurt = bytearray(png)
    hurt[big - 5] ^= 1
    note = b"Exif\0\0" + bytes(big)
    date = b"2001:02:03 04:05:06\0"
    tiff = b"II*\0" + struct.pack("<I", big) + bytes(big - 8) + struct.pack("<HHHIII", 1, 0x8769, 4, 1, big + 18, 0) + struct.pack("<HHHIII", 1, 0x9003, 2, 20, big + 36, 0) + date
    stamp = bytes(4) + struct.pack(">I", 3_000_000_000) + bytes(92)
    for whole in (content.WHOLE, 1 << 20):  # from memory, and met again by seeking
        monkeypatch.setattr(content, "WHOLE", whole)
        see = lambda name, data: content.inspect(put(tmp_path, name, bytes(data)))[3:6]
        assert see("a.png", png) == ("image/png", None, None) and see("b.png", hurt)[1] == "corrupt PNG chunk"
        assert see("c.png", png[:-300])[1] == "truncated PNG chunk" and see("d.png", png[:-12])[1] == "truncated PNG"
        assert see("e.jpg", jpeg_image(1, note=note) + bytes(2 << 20))[1:] == (None, None) and see("f.jpg", jpeg_image(1, note=note)[:-2])[1] == "missing EOI"
        data = [b"mvhd" + rnd.randbytes(3 << 20) for _ in range(3)]
        assert str(see("g.mp4", movie(data, mvhd=stamp))[2]) == "1999-01-24 05:20:00" and see("h.mp4", movie(data, mvhd=stamp, wide=True))[1:] == see("g.mp4", movie(data, mvhd=stamp))[1:]
        assert see("i.mp4", movie(data, shift=1))[1] == "Corrupt video: samples outside the media data"
        assert str(see("j.tif", tiff)[2]) == "2001-02-03 04:05:06"
