"""Queries whose SQL twins take less than the whole input, against brute force."""

import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from earshot.plans.registry import segments
from earshot.plans.sources import episode_tree
from earshot.session import table
from earshot.sources import files


@pytest.fixture(scope="module")
def run(spark, sf):
    return lambda name: entry.queries()[name](spark, sf)


def clean(text):
    return re.sub('"{2,}', '"', text.translate(str.maketrans("|\n\r\t", "/   "))).strip(" ")


def test_sanitize_takes_whole_pages(spark, sf, run):
    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    assert max(map(len, pages.values())) > 400
    assert {r.page_id: r.clean for r in run("x01_sanitize").collect()} == {k: clean(t) for k, t in pages.items()}


def test_names_and_titles_take_whole_texts(spark, sf, run):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    assert max(len(t or "") for t in docs.values()) > 200
    names = {k: re.sub("[^0-9a-z\u0600-\u06ff]+", " ", t.lower()).strip(" ") for k, t in docs.items()}
    assert {r.doc_id: r.name for r in run("x02_normalize_name").collect()} == names
    titles = {str(k): clean(t.replace('"', "")) for k, t in docs.items()}
    assert {r.doc_id: r.title for r in run("s03_write_registry").collect()} == titles


def test_components_of_all_orders(spark, sf, run):
    edges = {(r.o_custkey, r.o_custkey % 97 + 100000) for r in table(spark, sf, "orders").select("o_custkey").collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert {r.node: r.component for r in run("c10_components").collect()} == {x: root(x) for x in parent}


def test_resources_of_all_segments(spark, sf, run):
    want = defaultdict(float)
    for r in segments(spark, sf).select("region", "playlist", "file_id", "duration").collect():
        want[r.region, r.playlist, str(r.file_id)] += r.duration
    got = {(r.region, r.playlist, r.file_id): r.seconds for r in run("s01_read_resources").collect()}
    assert got == pytest.approx(dict(want), abs=1e-4)


def test_capped_draw_fills_cells_of_23(spark, sf, run):
    cells = {tuple(r) for r in segments(spark, sf).select("region", "tier").distinct().collect()}
    got = run("t08_capped_stratified").collect()
    assert {(r.region, r.tier) for r in got} == cells and all(r.n == 23 and r.speaker_ok and r.channel_ok for r in got)


def test_sidecars_of_all_parts(spark, sf, run):
    want = sorted((r.p_name, r.p_retailprice) for r in table(spark, sf, "part").collect())
    assert len(want) > 50 and sorted(map(tuple, run("s06_read_sidecars").collect())) == want


def test_episodes_of_all_parts_from_a_tree_on_disk(spark, sf, run, monkeypatch):
    parts = table(spark, sf, "part").collect()
    got = {(r.folder.rsplit("/", 1)[1], r.stem): (r.has_turns, r.has_sidecar) for r in files.list_episodes(spark, episode_tree(spark, sf)).collect()}
    assert got == {(r.p_brand.replace("#", "-"), str(r.p_partkey)): (True, r.p_partkey % 20 < 10) for r in parts}
    tree = episode_tree(spark, sf)
    root, brands = tree.split("/")[-1], Counter(r.p_brand.replace("#", "-") for r in parts)
    listed = files.list_harvest(spark, tree, ("rttm", "json")).collect()
    assert {r.sub for r in listed} == {root} and all(r.file.endswith((".rttm", ".json")) for r in listed)
    assert Counter(r.playlist for r in listed if r.file.endswith("rttm")) == brands
    calls, real = [], files.list_episodes
    monkeypatch.setattr(files, "list_episodes", lambda *a: calls.append(a) or real(*a))
    assert len(run("s07_list_episodes").collect()) == len(parts) and calls


def test_trees_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """Spark's own file index would hold every file in the driver, and it leaves out empty files."""
    for name, text in {"a#1/x/1.json": '{"title": "one", "duration": 1.5}', "a#1/2.json": "\ufeff" + '{"title": "\u0634"}', "b%20/3.json": "{broken", "b%20/4.JSON": '[{"title": "l"}, {"title": "m"}]', "b%20/4.wav": "", "_hidden/5.json": "{}", "b%20/.6.json": "{}"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "empty").mkdir()
    seen = files.list_episodes(spark, str(tmp_path)).collect()
    assert [(r.folder, r.stem, r.has_turns, r.has_sidecar) for r in seen] == [(f"{tmp_path}/b%20", "4", False, True)]
    (tmp_path / "b%20/4.wav").unlink()
    monkeypatch.setattr(files, "FILES_A_TASK", 2)
    got = files.read_sidecars(spark, str(tmp_path))
    assert got.columns[0] == "id" and len(got.columns) == 10
    want = [("1.json", "one", 1.5), ("2.json", "\u0634", None), ("3.json", None, None), ("4.JSON", "l", None), ("4.JSON", "m", None)]
    assert sorted((r.file.rsplit("/", 1)[1], r.title, r.duration) for r in got.collect()) == want
    assert len(got.inputFiles()) < 4


def test_shuffles_grow_with_the_input(spark, tmp_path):
    """With a fixed number of shuffle partitions each task's sorts would grow with the input."""
    from earshot.session import INITIAL, scale_shuffles

    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(tmp_path / "lineitem.parquet", "wb") as f:
        f.truncate(1 << 30)
    scale_shuffles(spark, str(tmp_path))
    assert int(spark.conf.get(INITIAL)) == 128
    list(entry.queries().values())[0](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(INITIAL)) == usual
    entry._ready(lambda *_: None, False)(spark, "")
    assert spark.conf.get(INITIAL, None) is None
