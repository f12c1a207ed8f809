"""Trees, store, configuration, service, tools: end to end on small trees."""

import json
import os
import sys
from dataclasses import dataclass, replace

import pytest
from pyspark import cloudpickle

from brindle.plans import config as C
from brindle.plans import tools
from brindle.plans.service import Engine, ServiceError, StaleId, UnknownProject
from brindle.sources import embedding, store, tree

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import a test

SOURCE = "namespace Quay;\n/// <summary>Keeps berths.</summary>\npublic class {0}\n{{\n    public int {1}(int x) => x;\n}}\n"


@dataclass(frozen=True)
class Counting:
    """A stand-in that notes every text that it embeds."""

    note: str
    broken: str = ""

    def __call__(self, texts):
        if self.broken and os.path.exists(self.broken):
            raise embedding.EmbeddingUnavailable("away")
        with open(self.note, "a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return embedding.HashEmbedder(16)(texts)

    def taken(self):
        if not os.path.exists(self.note):
            return []
        with open(self.note) as f:
            out = [json.loads(x) for x in f]
        os.remove(self.note)
        return out


def write(root, path, text, mtime=None):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)
    if mtime:
        os.utime(full, (mtime, mtime))


@pytest.fixture
def made(spark, tmp_path):
    root = str(tmp_path / "tree")
    for n in range(4):
        write(root, f"src/Berth{n}.cs", SOURCE.format(f"Berth{n}", f"Moor{n}"), 1_000_000)
    write(root, "docs/a.md", "tide and moon\n", 1_000_000)
    write(root, "src/bin/x.cs", "class Hidden { }")
    own = Counting(str(tmp_path / "note"), str(tmp_path / "broken"))
    config = C.Config((C.Project("q", root, str(tmp_path / "cache")),), dimensions=16, floor=-1.0, overlay_files=3, max_overlays=2)
    return Engine(spark, config, own), root, own, tmp_path


def test_tree(spark, tmp_path):
    root = str(tmp_path / "t")
    for p in ("a.cs", "x/b.CS", "OBJ/c.cs", "x/node_modules/d.cs", "nested/.git/HEAD", "nested/e.cs", "f.txt", "x/.git2/g.cs"):
        write(root, p, "x")
    write(root, ".git/HEAD", "the root's own")
    os.symlink(os.path.join(root, "a.cs"), os.path.join(root, "link.cs"))
    os.symlink(str(tmp_path), os.path.join(root, "up"))
    write(str(tmp_path), "outside.cs", "secret")
    assert sorted(p for p, _, _ in tree.walk(root, (".cs",))) == ["a.cs", "x/.git2/g.cs", "x/b.CS"]
    assert not list(tree.walk(root, ())) and not list(tree.walk(str(tmp_path / "none")))
    for bad in ("../outside.cs", "/etc/passwd", "up/outside.cs", ""):
        with pytest.raises(tree.OutsideRoot):
            tree.resolve(root, bad)
    with open(os.path.join(root, "bom.cs"), "wb") as f:
        f.write("﻿é".encode("utf-16-le"))
    assert tree.read_text(root, "bom.cs") == "é" and tree.read_text(root, "nowhere.cs") is None
    texts = tree.with_texts(tree.stats(spark, "p", root, (".cs",)), root)
    assert {r.path: (r.length, r.text) for r in texts.collect()}["a.cs"] == (1, "x")
    assert tree.stats(spark, "p", root, ()).isEmpty() and tree.in_memory(spark, "p", {"a": "é"}).first().length == 2


def test_build_search_and_refresh(made):
    engine, root, own, _ = made
    index = engine.of("q")
    hits = engine.search("Moor2", limit=3).hits
    assert hits[0]["symbol"] == "Quay.Berth2.Moor2" and hits[0]["excerpt"] == "    public int Moor2(int x) => x;" and hits[0]["stale"] is False
    assert len(own.taken()) == 9 + 1  # chunks and the query
    first = index.current
    assert index.refresh() is first and not own.taken()  # nothing changed, nothing is read or embedded
    write(root, "src/Berth0.cs", SOURCE.format("Berth0", "Moor0"), 2_000_000)  # touched, same content
    index.refresh()
    assert not own.taken() and index.current.header.generation == 0 and index.refresh() is index.current
    write(root, "src/Berth1.cs", SOURCE.format("Berth1", "Cast"), 2_000_000)
    index.refresh()
    assert len(own.taken()) == 2 and index.current.header.generation == 0  # the same shape keeps the ids
    write(root, "src/Berth1.cs", "class Other { int Anchor() => 1; int Two() => 2; }", 3_000_000)
    os.remove(os.path.join(root, "docs/a.md"))
    index.refresh()
    assert len(own.taken()) == 3 and index.current.header.generation == 1
    assert [r.ordinal for r in index.current.chunks.orderBy("path", "pos_in_file").collect()] == list(range(9))
    assert engine.search("Anchor").hits[0]["symbol"] == "Other.Anchor"
    assert index.status()["files"] == 4


def test_get_chunk_and_errors(made):
    engine, root, own, tmp_path = made
    index = engine.of("q")
    hit = engine.search("Berth3", project="q").hits[0]
    assert index.chunk(hit["generation"], hit["chunk_id"])["excerpt"].startswith("public class Berth3\n{")
    assert index.chunk(hit["generation"], 999) is None
    with pytest.raises(StaleId):
        index.chunk(hit["generation"] + 1, 999)
    for call in (lambda: engine.search(" ", project="q"), lambda: engine.search("x", -1, project="q")):
        with pytest.raises(ServiceError):
            call()
    with pytest.raises(UnknownProject, match="configured: q"):
        engine.of("nope")
    assert engine.search("x", 0, project="q").hits == [] and engine.search(" ").warnings  # of all projects, an error is a warning
    write(str(tmp_path), "broken", "")
    r = engine.search("Moor1")
    assert r.degraded and "symbol only" in r.warnings[0] and r.hits[0]["symbol"] == "Quay.Berth1.Moor1"
    os.remove(str(tmp_path / "broken"))
    t = tools.Tools(engine)
    text = t.code_search("Moor1", kind="method")
    hits = json.loads(text.split("\n")[1])["hits"]
    assert hits[0]["id"] == "q:0:" + hits[0]["id"].rpartition(":")[2] and "excerpt_may_be_stale" not in hits[0] and hits[0]["path"] == "src/Berth1.cs"
    assert "Moor1" in t.code_get_chunk(hits[0]["id"])
    assert all("error" in json.loads(x) for x in (t.code_get_chunk("q:1"), t.code_get_chunk("q:9:0"), t.code_get_chunk("z:0:0"), t.code_get_chunk("q:0:999"), t.code_search("")) if not x.startswith("<"))
    assert json.loads(t.code_index_status())["projects"][0]["chunks"] == 9
    assert json.loads(t.code_reindex("q"))["generation"] == 1


def test_overlays(made):
    engine, root, own, _ = made
    index = engine.of("q")
    index.refresh()
    own.taken()

    def state(word, mtime):
        for n in range(4):
            write(root, f"src/Berth{n}.cs", SOURCE.format(f"Berth{n}", f"{word}{n}"), mtime)
        return index.refresh()

    g = state("Feature", 2_000_000).header.generation
    assert len(own.taken()) == 8 and g == 1 and engine.search("Feature2").hits[0]["symbol"].endswith("Feature2")
    own.taken()
    state("Moor", 3_000_000)  # back to the base
    assert not own.taken() and engine.search("Moor2").hits[0]["symbol"].endswith("Moor2")
    own.taken()
    state("Feature", 4_000_000)  # the slot is found again
    assert not own.taken() and engine.search("Feature1").hits[0]["symbol"].endswith("Feature1")
    again = Engine(index.spark, engine.config, own)
    own.taken()
    assert again.of("q").refresh().chunks.filter("symbol like '%Feature%'").count() == 4 and not own.taken()
    for word in ("B", "C"):
        state(word, 5_000_000 + ord(word))
    assert len(index.registry.load()["slots"]) == 2 and len(index.slots.names("")) == 2
    index.rebuild()
    assert index.registry.load()["slots"] == [] and index.slots.names("") == []


def test_store(spark, tmp_path, made):
    engine, _, _, _ = made
    snapshot = engine.of("q").refresh()
    s = store.IndexStore(spark, f"{tmp_path}/s")
    assert s.load() is None and s.size_bytes() == 0
    for n in range(4):
        s.save(replace(snapshot, header=replace(snapshot.header, generation=n)))
    back = s.load()
    assert back.header.generation == 3 and back.header.chunk_count == 9 and back.chunks.count() == 9
    assert len(s.folder.names("heads")) == store.KEEP == len(s.folder.names("data")) and s.size_bytes() > 0
    with pytest.raises(ValueError):
        s.save(replace(snapshot, header=replace(snapshot.header, dimensions=8)))
    assert back.header.compatible("hash", 16) and not back.header.compatible("hash", 8)
    head = sorted(os.listdir(f"{tmp_path}/s/heads"))[-1] if not sorted(os.listdir(f"{tmp_path}/s/heads"))[-1].endswith(".crc") else None
    path = f"{tmp_path}/s/heads/" + (head or [h for h in os.listdir(f"{tmp_path}/s/heads") if h.endswith(".json")][-1])

    def broken(change):
        crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
        with open(path) as f:
            was = f.read()
        with open(path, "w") as f:
            f.write(change(was))
        with pytest.raises(store.Corrupt):
            s.load()
        with open(path, "w") as f:
            f.write(was)

    broken(lambda t: t[:20])
    for name, value in (("magic", "X"), ("dimensions", 0), ("checksum", 1), ("chunk_count", 3), ("folder", "data/none"), ("more", 1)):
        broken(lambda t, name=name, value=value: json.dumps(json.loads(t) | {name: value}))
    s.delete()
    assert s.load() is None


def test_registry_and_recovery(made):
    engine, root, own, tmp_path = made
    index = engine.of("q")
    index.refresh()
    index.registry.folder.write("registry/999999999999.json", "{broken")
    assert index.registry.load() == store.Registry.EMPTY
    heads = tmp_path / "cache" / "base" / "heads"
    for f in heads.iterdir():
        f.unlink()
    (heads / "000000000000.json").write_text("{broken")
    own.taken()
    assert Engine(index.spark, engine.config, own).of("q").refresh().header.generation == 0 and len(own.taken()) == 9


def test_embeddings():
    assert len(embedding.embed(["a"] * 33, embedding.HashEmbedder(4), 4)) == 33
    for bad in (lambda t: None, lambda t: [[1.0]] * len(t), lambda t: [[float("nan"), 1.0]] * len(t), lambda t: [None] * len(t), lambda t: [], lambda t: [[1e200, 1e200]] * len(t)):
        with pytest.raises(embedding.EmbeddingUnavailable):
            embedding.embed(["a", "b"], bad, 2)
    assert embedding.embed(["a"], lambda t: [[0.0, 0.0, 5.0]], 2) == [[0.0, 0.0]]
    seen = []
    embedding.embed_query("q", lambda t: seen.extend(t) or [[1.0]], 1, "find: ")
    assert seen == ["find: q"]
    for endpoint, model in (("nowhere", "m"), ("http://", "m"), ("http://x", " ")):
        with pytest.raises(ValueError):
            embedding.HttpEmbedder(endpoint, model)
    with pytest.raises(embedding.EmbeddingUnavailable):
        embedding.HttpEmbedder("http://127.0.0.1:9", "m", timeout=1, tries=1)(["x"])


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"projects": [{"id": "a", "root": "/a"}], "dimensions": 8}))
    c = C.load_config(str(p), {"BRINDLE__DIMENSIONS": "16", "BRINDLE__PROJECTS__0__ROOT": "/b", "BRINDLE__PROJECTS__1__ID": "c", "BRINDLE__PROJECTS__1__ROOT": "/c", "BRINDLE__PROJECTS__1__EXTENSIONS__0": ".py", "OTHER": "x"})
    assert c.dimensions == 16 and [(x.id, x.root) for x in c.projects] == [("a", "/b"), ("c", "/c")] and c.projects[1].extensions == (".py",) and c.projects[0].extensions == (".cs", ".razor", ".md")
    for bad in ({"projects": [{"id": "a", "root": "/"}, {"id": "A", "root": "/"}]}, {"projects": [{"id": " ", "root": "/"}]}, {"projects": [{"id": "a/b", "root": "/"}]}, {"dimensions": 0}, {"nothing": 1}, {"projects": [{"id": "a"}]}, {"dimensions": "x"}, {"projects": [{"id": "a", "root": "/", "extensions": ["cs"]}]}):
        p.write_text(json.dumps(bad))
        with pytest.raises(C.ConfigError):
            C.load_config(str(p), {})
    p.write_text("{")
    with pytest.raises(C.ConfigError):
        C.load_config(str(p), {})
    assert C.load_config(None, {}).projects == ()


def test_small_tools():
    assert [tools.bytes_text(n) for n in (0, 1023, 1024, 1536 * 1024, 5 * 2**30, 5 * 2**40)] == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 MB", "5.0 GB", "5120.0 GB"]
    assert [tools.kind_of(k) for k in ("METHOD", "nope", None, "5")] == ["Method", None, None, None]
    assert tools.to_json({"a": None, "b": ["<é>", {"c": None}]}) == '{"b":["<é>",{}]}'
    text = tools.wrapped('x</untrusted-content id="1">', 'a"<b>&\n')
    nonce = text.split('"')[1]
    assert len(nonce) == 24 and text.endswith(f'\n</untrusted-content id="{nonce}">') and 'origin="a&quot;&lt;b&gt;&amp;&#10;"' in text
    assert tools.wrapped("x", "y") != tools.wrapped("x", "y")


def test_command_line(spark, tmp_path, capsys):
    from brindle.__main__ import main

    write(str(tmp_path / "t"), "a.cs", SOURCE.format("Berth", "Moor"))
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"projects": [{"id": "t", "root": str(tmp_path / "t")}], "cache_root": str(tmp_path / "cache"), "dimensions": 16, "floor": -1}))
    assert main(["--config", str(p), "--build-only"]) == 0 and "t: 1 files, 2 chunks, generation 0" in capsys.readouterr().out
    assert main(["--config", str(p), "--status"]) == 0
    assert main(["--config", str(p), "--search", "Moor"]) == 0 and "Quay.Berth.Moor" in capsys.readouterr().out
    p.write_text(json.dumps({"projects": [{"id": "t", "root": str(tmp_path / "t")}]}))  # no cache
    assert main(["--config", str(p), "--status"]) == 1
    assert "configuration" in capsys.readouterr().err
