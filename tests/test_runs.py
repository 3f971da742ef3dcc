"""Attempts and uploads against plain forms."""

import random
import re
from datetime import datetime, timedelta
from pathlib import PurePosixPath

import pytest

from ashlar.operators import attempts, jobs, manifest, uploads

TRIED = "call_id string, attempt int, took_ms long, error string"


def plain_schedule(rows):
    """A call as a loop: try, wait, try again."""
    best = {}
    for call, attempt, took, error in rows:
        if attempt is not None and 1 <= attempt <= 5:
            row = (took or 0, error is not None, error or "")
            best[call, attempt] = min(best.get((call, attempt), row), row)
    out = {}
    for call in {c for c, _ in best}:
        clock, over = 0, False
        for attempt in range(1, 6):
            if (call, attempt) not in best:
                continue
            took, failed, error = best[call, attempt]
            if over:
                out[call, attempt] = ("unused", 0, None)
                continue
            wait = 0
            if failed and attempt < 5:
                wait = 3000
                if "429" in error or "rate_limit" in error.lower():
                    named = re.search(r"try again in (\d+(?:\.\d+)?)(ms|s)", error)
                    wait = round(float(named[1]) * (1 if named[2] == "ms" else 1000)) + 1000 if named else 3000 * attempt
            out[call, attempt] = ("done" if not failed else "raised" if attempt == 5 else "waits", wait, clock)
            clock, over = clock + took + wait, not failed
    return out


def test_schedules_equal_the_loop(spark):
    rng = random.Random(5)
    errors = [None, "timed out", "429", "429: try again in 250ms", "RATE_LIMIT, try again in 2.5s please", "try again in 9s", "rate_limit: try again in s", ""]
    rows = [(f"c{rng.randrange(60)}", rng.choice([None, 0, 1, 2, 3, 4, 5, 6]), rng.choice([None, 0, 70, 900]), rng.choice(errors)) for _ in range(900)]
    rows += [(None, 1, 5, "x"), (None, 2, 5, None)]  # a null id is a call
    found = attempts.schedule(spark.createDataFrame(rows, TRIED)).collect()
    assert {(r.call_id, r.attempt): (r.outcome, r.wait_ms, r.begins_ms) for r in found} == plain_schedule(rows)
    assert len(found) == len(plain_schedule(rows)) and {r.outcome for r in found} == {"done", "raised", "waits", "unused"}
    sums = attempts.calls(attempts.schedule(spark.createDataFrame([("a", 1, 10, "429"), ("a", 2, 20, None), ("a", 3, 5, None), ("b", 1, 7, "x")], TRIED)))
    assert sorted(map(tuple, sums.collect())) == [("a", 2, "done", 3000, 3030), ("b", 1, "waits", 3000, 3007)]


@pytest.mark.parametrize("error, wait", [("429 try again in " + "9" * 400 + "s", 6000), ("429 try again in 99999999999999999999s", 6000), ("429 try again in 0.4ms", 1000)])
def test_waits_that_no_long_holds_are_none(spark, error, wait):
    rows = attempts.schedule(spark.createDataFrame([("a", 2, 0, error)], TRIED))
    assert [r.wait_ms for r in rows.collect()] == [wait]
    assert attempts.schedule(spark.createDataFrame([], TRIED)).count() == 0


FILES = "upload_id long, name string, bytes long, at timestamp"


def plain_admission(rows, listing):
    """Uploads in order of time beside the files that are there."""
    kept = sorted((at or datetime(1970, 1, 1), i, PurePosixPath(name).name) for i, name, size, at in rows if name and name.lower().endswith(".pdf") and size and 0 < size <= 1000)
    begun, names, out = {}, set(listing), {}
    for at, i, name in kept:
        begun.setdefault(name, (at, i))
    names |= set(begun)
    seconds = {}
    for at, i, name in kept:
        if name not in listing and begun[name] == (at, i):
            out[i] = name
            seconds.setdefault((PurePosixPath(name).stem, at.replace(microsecond=0)), i)
            continue
        stamp = f"{PurePosixPath(name).stem}_{at:%Y%m%d_%H%M%S}"
        first = seconds.setdefault((PurePosixPath(name).stem, at.replace(microsecond=0)), i) == i
        out[i] = f"{stamp}.pdf" if first and f"{stamp}.pdf" not in names else f"{stamp}_{i}.pdf"
    return out


def test_admission_equals_the_plain_form(spark):
    rng = random.Random(6)
    start = datetime(2024, 5, 1, 12)
    stems = ["a", "b", "x/a", "deep/er/c.v2", "a_20240501_120003", "", ".", "é"]
    rows = [(i, rng.choice(stems) + rng.choice([".pdf", ".pdf", ".PDF", ".txt", ""]), rng.choice([None, 0, 1, 500, 1000, 1001]), start + timedelta(milliseconds=250 * rng.randrange(60))) for i in range(600)]
    rows += [(700, None, 5, start), (701, "z.pdf", 5, None), (702, "z.pdf", 5, None)]
    listing = ["b.pdf", "c.v2.pdf", "a_20240501_120005.pdf"]
    found = uploads.admitted(spark.createDataFrame(rows, FILES), spark.createDataFrame([(x,) for x in [*listing, listing[0], None]], "name string"), most=1000).collect()
    assert len(found) == len(rows)
    got = {r.upload_id: r.file for r in found if r.verdict == "accepted"}
    assert got == plain_admission(rows, set(listing))
    assert len(set(got.values())) == len(got) and not set(got.values()) & set(listing)  # nothing is written over
    assert {r.verdict for r in found} == {"accepted", "empty", "too large", "not a pdf"} and all(r.file is None for r in found if r.verdict != "accepted")
    assert uploads.admitted(spark.createDataFrame([], FILES), spark.createDataFrame([], "name string")).count() == 0


RASTERS = "source string, page long, xref long, pos long, width long, height long, ext string, hash string, x0 double, y0 double, x1 double, y1 double"
REGIONS = "source string, page long, x0 double, y0 double, x1 double, y1 double, hash string"
LINES = "source string, page long, id long, x0 double, y0 double, x1 double, y1 double, text string"


def at(x, y, wide, high):
    return float(x), float(y), float(x + wide), float(y + high)


def test_the_manifest_of_planted_pages(spark):
    rasters = [
        ("d", 1, 7, 0, 300, 200, "jpeg", "logo", *at(10, 10, 40, 30)),  # recurs small on four pages
        ("d", 1, 8, 1, 300, 200, "jpeg", "photo", *at(50, 200, 100, 80)),
        ("d", 1, 8, 2, 300, 200, "jpeg", "photo", *at(50, 400, 200, 160)),  # the larger placement
        ("d", 1, 9, 3, 300, 200, "png", "icon", *at(5, 5, 12, 9)),  # too small on the page
        ("d", 1, 10, 4, 23, 200, "png", "rule", *at(0, 0, 300, 300)),  # too few pixels
        ("d", 1, 11, 5, 90, 90, "png", "loose", None, 1.0, 2.0, 3.0),  # no place
        ("d", None, 1, 0, 90, 90, "png", "x", *at(0, 0, 50, 50)),
        *[("d", p, 7, 0, 300, 200, "jpeg", "logo", *at(10, 10, 40, 30)) for p in (2, 3, 4)],
        *[("d", p, 8, 1, 300, 200, "png", "large", *at(10, 10, 40, 80 if p == 3 else 30)) for p in (2, 3, 4, 5)],  # large once
        *[("e", p, 1, 0, 300, 200, "jpeg", "logo", *at(10, 10, 40, 30)) for p in (1, 2, 3)],  # on three pages of its document
        *[("f", p, 1, 0, 104, 100, "png", "unplaced", None, None, None, None) for p in (1, 2, 3, 4)],  # 78 points by its pixels
        *[("g", p, 1, 0, 300, 200, "png", None, *at(10, 10, 40, 30)) for p in (1, 2, 3, 4)],
    ]
    regions = [("d", 1, *at(60, 410, 100, 100), "inside"), ("d", 1, *at(150, 480, 200, 160), "beside"), ("d", 1, *at(300, 20, 100, 100), "drawn"), ("d", 1, *at(300, 20, 11, 100), "thin"), ("d", 6, *at(0, 0, 60, 60), "alone"), ("d", 6, *at(0, 0, 60, 60), "alone"), ("d", 6, None, 0.0, 1.0, 1.0, "open")]
    lines = [("d", 1, 1, *at(50, 380, 150, 12), " Fig. 1:  The  pump - "), ("d", 1, 2, *at(50, 570, 150, 12), "below"), ("d", 1, 3, *at(310, 125, 80, 12), "drawn below"), ("e", 1, 1, *at(10, 0, 40, 8), None), ("d", 1, 9, None, 0.0, 1.0, 1.0, "open")]
    read = spark.createDataFrame([("loose", "Read : "), ("loose", "Zz"), ("photo", "not asked"), (None, "no")], "hash string, title string")
    build = lambda *r: manifest.manifest(*(spark.createDataFrame(x, s) for x, s in zip(r, (RASTERS, REGIONS, LINES))), read=read)
    kept = build(rasters, regions, lines)
    rows = kept.collect()
    got = {(r.source, r.page, r.number): (r.file, r.hash, r.title, r.kind) for r in rows}
    assert len(got) == len(rows)
    assert {k: v for k, v in got.items() if k[:2] == ("d", 1)} == {
        ("d", 1, 2): ("page_1_img_2.jpeg", "photo", "Fig. 1: The pump", "embedded"),
        ("d", 1, 3): ("page_1_img_3.png", "loose", "Read", "embedded"),
        ("d", 1, 4): ("page_1_img_4.png", "drawn", "drawn below", "rendered"),
        ("d", 1, 5): ("page_1_img_5.png", "beside", got["d", 1, 5][2], "rendered"),
    }
    assert [r.x1 - r.x0 for r in rows if r.hash == "photo"] == [200.0]
    assert {k for k, v in got.items() if v[1] == "large"} == {("d", 2, 2), ("d", 3, 2), ("d", 4, 2), ("d", 5, 1)}
    assert sum(v[1] == "logo" for v in got.values()) == 3 and not any(v[1] == "unplaced" for v in got.values()) and sum(k[0] == "g" for k in got) == 4
    assert [(v[0], v[1]) for k, v in got.items() if k[:2] == ("d", 6)] == [("page_6_img_1.png", "alone")]
    page = manifest.envelopes(kept).where("source = 'd' and page = 1").first()
    assert [x.path for x in page.images] == [f"images/{got['d', 1, n][0]}" for n in (2, 3, 4, 5)]
    whole = {r.source: r for r in manifest.summary(kept).collect()}
    assert (whole["d"].total, whole["d"].pages, whole["d"].embedded, whole["d"].rendered, whole["d"].per_page) == (9, 6, 6, 3, 1.5) and set(whole) == {"d", "e", "g"}
    assert build([], [], []).count() == 0 and manifest.summary(build([], [], [])).count() == 0


def test_commands_equal_the_plain_fold(spark):
    rng = random.Random(8)
    held = [(i, rng.choice(["queued", "running", "done", "error", None]), f"f{i}") for i in range(40)]
    told = [(n, rng.choice([*range(44), None]), rng.choice(["cancel", "cancel", "retry", "delete", "look", None]), rng.choice([None, *range(60)])) for n in range(700)]
    frame = spark.createDataFrame(held + held[:3], "job_id long, status string, file string")
    got = jobs.obeyed(frame, spark.createDataFrame(told, "command_id long, job_id long, action string, at_ms long"))
    state, want, new = {i: s for i, s, _ in held}, {}, []
    for n, job, action, _ in sorted(told, key=lambda c: (-1 if c[3] is None else c[3], c[0])):
        active = state.get(job) in ("queued", "running")
        if job not in state or action not in ("cancel", "retry", "delete"):
            want[n] = "unknown"
        elif action == "cancel":
            want[n] = "cancelled" if active else "nothing to cancel"
            state[job] = "cancelled" if active else state[job]
        elif action == "retry":
            want[n] = "queued"
            new.append((f"{job}-r-{n}", "queued", f"f{job}"))
        else:
            want[n] = "refused" if active else "deleted"
            if not active:
                del state[job]
    assert {r.command_id: r.outcome for r in got.collect()} == want and got.count() == len(told)
    assert set(want.values()) == {"unknown", "cancelled", "nothing to cancel", "queued", "refused", "deleted"}
    left = sorted(map(tuple, jobs.after(frame, got).collect()))
    assert left == sorted([(str(i), s or "", f"f{i}") for i, s in state.items()] + new)
