"""Mappings, classification, dumps, streams and the engine on small tables."""

import time

import pytest

from maskframe.config import Config, parse_rules, read_env, service_settings, write_rules
from maskframe.engine import Engine, NothingMasked
from maskframe.functions import validate
from maskframe.operators import mapping as M
from maskframe.operators import provider
from maskframe.plans import classify
from maskframe.sources import dumps, sqldump
from maskframe.streaming import apply as streaming

DUMP = """-- Charset: utf8
SET NAMES 'utf8';
CREATE TABLE `Artist` (`Id` int, `Name` varchar(9));
INSERT INTO `Artist` (`ArtistId`, `Name`, `Phone`, `Email`, `Born`) VALUES
(1, N'AC/DC', '+1 (425) 555-0174', 'a.b@c.de', '2020-02-29'),
(2, 'O''Brien (Live), x', '8-800-555-35-35' , 'x99@y.org', '2021-05-06 10:00:00'),
(3, 'line\\nbreak
raw', NULL, "q@z.com", 2020-01-01);
ALTER TABLE `Artist` ADD (`x` int);
INSERT INTO `T_x` (`id`, `T_x`) VALUES (1,'a),(b'),(2,'INSERT INTO x'),(3,NOW());
"""


def pairs(df):
    return {r["original"]: r["replacement"] for r in df.collect()}


def test_cycles(spark):
    df = spark.createDataFrame([(1, "Rock"), (2, "Jazz"), (3, "Rock"), (4, "Metal"), (5, None), (6, " ")], "p int, g string")
    assert pairs(M.rotation(df, "g", "p")) == {"Rock": "Jazz", "Jazz": "Metal", "Metal": "Rock"}
    assert pairs(M.sorted_cycle(df, "g")) == {"Jazz": "Metal", "Metal": "Rock", "Rock": "Jazz"}
    one = spark.createDataFrame([("x",)], "g string")
    assert pairs(M.sorted_cycle(one, "g")) == {"x": "x"}
    assert pairs(M.sorted_cycle(one.limit(0), "g")) == {}
    many = spark.range(500).selectExpr("lpad(id, 4, '0') g")
    got = pairs(M.sorted_cycle(many, "g"))
    assert all(got[f"{i:04}"] == f"{(i + 1) % 500:04}" for i in range(500))


def test_merges_and_unknown(spark):
    a = spark.createDataFrame([(None, "x", "1"), ("c", "x", "2")], M.SCHEMA)
    b = spark.createDataFrame([(None, "x", "9"), (None, "y", "3"), ("c", "y", "4")], M.SCHEMA)
    assert {tuple(r) for r in M.first_wins(a, b).collect()} == {(None, "x", "1"), ("c", "x", "2"), (None, "y", "3"), ("c", "y", "4")}
    df = spark.createDataFrame([("x",), ("z",), (None,)], "v string")
    assert [r[0] for r in M.apply(df, "v", a, "c").collect()] == ["2", "z", None]
    with pytest.raises(Exception, match="no replacement"):
        M.apply(df, "v", a, "c", "fail").collect()


def test_classify_rules(spark):
    df = spark.createDataFrame([("+1 (425) 555-0174", "a@b.de", "2020-01-01", "Bern", "1", "x")] + [("+1 (425) 555-0175", "b@b.de", "2021-01-01", "Rom", "2", "y")], "tel string, m string, d string, city string, n string, CustomerId string")
    got = {r["column"]: r["type"] for r in classify.classify(df, "t", {"t.city": "name"}).collect()}
    assert got == {"tel": "phone", "m": "email", "d": "date_shuffle_year", "city": "name", "n": "skip", "CustomerId": "skip"}


def test_dump_round_trip(spark, tmp_path):
    path = tmp_path / "d.sql"
    path.write_text(DUMP, encoding="utf-8")
    raw = [r["raw"] for r in dumps.read(spark, str(path)).orderBy("seq").collect()]
    assert "".join(raw) == DUMP
    out = tmp_path / "out.sql"
    assert dumps.mask_dump(spark, str(path), str(out), Engine(spark, Config({"Artist.Name": "name", "Artist.Born": "date_shuffle_year", "T_x.T_x": "genre"}))) == 6
    text = out.read_text(encoding="utf-8")
    assert "+1 (423) 346-9221" in text and "NOW());" in text and "N'O''Brien (Live), x'" in text and "ALTER TABLE `Artist` ADD (`x` int);" in text
    assert [r["row"] for r in dumps.read(spark, str(out)).where("kind = 'row'").orderBy("seq").collect()] == [1, 2, 3, 1, 2, 3]


@pytest.mark.parametrize("encoding", ["cp1251", "utf-8-sig", "koi8-r"])
def test_dump_keeps_its_encoding(spark, tmp_path, encoding):
    name = {"cp1251": "cp1251", "utf-8-sig": "utf8", "koi8-r": "koi8r"}[encoding]
    dump = f"SET NAMES '{name}';\nINSERT INTO `p` (`id`, `name`) VALUES\n(1, 'Борис'),\n(2, 'Анна');\n"
    path, out = tmp_path / "d.sql", tmp_path / "o.sql"
    path.write_bytes(dump.encode(encoding))
    assert dumps.mask_dump(spark, str(path), str(out), Engine(spark, Config({"p.name": "name"}))) == 2
    assert out.read_bytes() == dump.replace("Борис", "?").replace("Анна", "Борис").replace("?", "Анна").encode(encoding)
    before, after = dumps.read(spark, str(path)), dumps.read(spark, str(out))
    assert dumps.structure_changed(before, after).count() == 0
    out.write_bytes(out.read_bytes().replace(b"(2, ", b"(2 ,"))
    assert dumps.structure_changed(before, dumps.read(spark, str(out))).count() == 1


def test_dump_statement_of_many_lines():
    lines = ["INSERT INTO `t` (`id`, `x`) VALUES\n", *(f"({i}, 'a;\n b''c'),\n" for i in range(40_000)), "(0, 'end');\n"]
    began = time.time()
    got = list(sqldump.segments(iter("".join(lines).splitlines(keepends=True))))
    assert sum(x[1] == "row" for x in got) == 40_001 and "".join(x[5] for x in got) == "".join(lines)
    assert time.time() - began < 30


def test_dump_with_nested_calls_and_empty_tokens(spark, tmp_path):
    dump = "INSERT INTO `p` (`id`, `x`, `name`) VALUES (1, f(g(2)), 'Bob'),(2, f(3), 'Tim') , (h(i(j('a)('), 4)),, 'Ann''s'),\n(4, NULL, 'Eve)') /* end */;\n"
    dump += "INSERT INTO p (id, x, name) VALUES (5,,'Ida'); INSERT INTO `q` VALUES ((1+(2*3)),'Max') ON DUPLICATE KEY UPDATE a=VALUES(a);\n"
    path, out = tmp_path / "d.sql", tmp_path / "out.sql"
    path.write_text(dump, encoding="utf-8")
    got = dumps.read(spark, str(path)).orderBy("seq").collect()
    assert "".join(r["raw"] for r in got) == dump
    rows = [(r["table"], r["row"], [t.strip() for t in r["tokens"]]) for r in got if r["kind"] == "row"]
    assert rows == [
        ("p", 1, ["1", "f(g(2))", "'Bob'"]), ("p", 2, ["2", "f(3)", "'Tim'"]), ("p", 3, ["h(i(j('a)('), 4))", "", "'Ann''s'"]), ("p", 4, ["4", "NULL", "'Eve)'"]),
        ("p", 5, ["5", "", "'Ida'"]), ("q", 1, ["(1+(2*3))", "'Max'"]),
    ]
    assert dumps.mask_dump(spark, str(path), str(out), Engine(spark, Config({"p.name": "name"}))) == 6
    text = out.read_text(encoding="utf-8")
    before, after = ([r["tokens"][2].strip() for r in x if r["kind"] == "row" and r["table"] == "p"] for x in (got, dumps.read(spark, str(out)).orderBy("seq").collect()))
    assert all(a != b for a, b in zip(before, after, strict=True)) and "f(g(2))" in text and "(5,," in text


def test_dump_rows_of_other_lengths(spark, tmp_path):
    """Values beyond the named columns stay, and so do rows that end before them."""
    dump = "INSERT INTO `p` (`id`, `name`) VALUES (1, 'Bob', 'extra'),(2),(3, 'Tim'),();\n"
    path, out = tmp_path / "d.sql", tmp_path / "o.sql"
    path.write_text(dump)
    assert dumps.mask_dump(spark, str(path), str(out), Engine(spark, Config({"p.name": "name"}))) == 4
    assert out.read_text() == "INSERT INTO `p` (`id`, `name`) VALUES (1, 'Tim', 'extra'),(2),(3, 'Bob'),();\n"


@pytest.mark.parametrize("values", ["(1, 'a'", "(1, 'a);\n", "(1, f(2);\n", "(1) x (2);\n", "(1) (2);\n", "x;\n"])
def test_dump_that_cannot_be_parsed(values):
    with pytest.raises(ValueError):
        list(sqldump.segments(iter([f"INSERT INTO t (a) VALUES {values}"])))


def test_nothing_to_mask(spark, tmp_path):
    path = tmp_path / "d.sql"
    path.write_text("INSERT INTO t VALUES (1, 'a');\n")
    with pytest.raises(NothingMasked):
        dumps.mask_dump(spark, str(path), str(tmp_path / "o.sql"))
    assert not (tmp_path / "o.sql").exists()


def test_encodings():
    text = "SET NAMES 'cp1251';\nпривет"
    assert sqldump.sniff(text.encode("cp1251")) == "cp1251"
    assert sqldump.sniff(b"\xef\xbb\xbfabc") == "utf-8-sig"
    assert sqldump.sniff("naïve €".encode()[:-1]) == "utf-8"
    assert sqldump.charset("utf8mb4") == "utf-8" and sqldump.charset("ISO_8859-1") == "cp1252" and sqldump.charset("maccyr") == "mac-cyrillic" and sqldump.charset("nonsense") is None


def test_provider(spark):
    asked = []

    def ask(request):
        values = request.values
        asked.append(len(values))
        return "" if len(values) > 5 else "{" + ", ".join(f'"{v}": "new {v}"' for v in values) + ', "unasked": "x"}'

    df = spark.createDataFrame([(f"v{i:02}",) for i in range(12)], "value string")
    got = pairs(provider.Service(ask, retry_pause=0).generate(df, "f"))
    assert got == {f"v{i:02}": f"new v{i:02}" for i in range(12)}
    assert len(provider.chunk_plan([f"v{i}" for i in range(270)])) == 14
    assert provider.chunk_timeout(20, 1000) == 93
    assert validate.extract_json("{'a': 'b'}") == {"a": "b"} and validate.extract_json("x") == {}


def test_service_retries_and_settings(spark):
    calls = []

    def ask(request):
        calls.append((len(request.values), request.max_tokens, request.timeout))
        if request.max_tokens < 65_536:
            raise provider.BudgetSpent
        return "{" + ", ".join(f'"{v}": "x {v}"' for v in request.values) + "}"

    got = provider.Service(ask, retry_pause=0).answer("f", ["a", "b"])
    assert got == {"a": "x a", "b": "x b"} and [c[:2] for c in calls] == [(2, 32_768), (2, 65_536)] and calls[0][2] < calls[1][2]
    tried = []

    def fails(request):
        tried.append(len(request.values))
        raise TimeoutError

    assert provider.Service(fails, retry_pause=0).answer("f", list("abcdefgh")) == {} and tried == [8, 8, 4, 4, 2, 2, 2, 2, 4, 4, 2, 2, 2, 2]
    assert provider.estimate_chars(["a", "b"]) == 560 and "3 earlier" in provider.format_rules("f", 3)
    s = service_settings(None, {"LLM_PROVIDER": "Local", "LLM_MODEL": "m", "LLM_API_TOKEN": "k", "SAMPLES_PER_FIELD": "7"})
    assert (s.endpoint, s.model, s.key, s.samples_per_field) == ("http://localhost:11434/v1", "m", "k", 7)


def test_read_env(tmp_path):
    (tmp_path / "e").write_text("# c\nLLM_MODEL = 'm n'\nnonsense\nA=b=c\n")
    assert read_env(str(tmp_path / "e")) == {"LLM_MODEL": "m n", "A": "b=c"} and read_env(str(tmp_path / "no")) == {}


def test_engine_rotates_what_it_has_not_seen(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["Rock", "Jazz", "Rock", "Metal", "Blues"])], "p int, g string")
    engine, types = Engine(spark), {("t", "g"): "genre"}
    first = engine.mappings({"t": df}, types, positions={"t": "p"})
    assert pairs(first) == {"Rock": "Jazz", "Jazz": "Metal", "Metal": "Blues", "Blues": "Rock"}
    more = spark.createDataFrame([(0, "Folk"), (1, "Jazz"), (2, "Ambient")], "p int, g string")
    both = pairs(engine.mappings({"t": more}, types, first, {"t": "p"}))
    assert both == pairs(first) | {"Folk": "Ambient", "Ambient": "Folk"} and sorted(both) == sorted(both.values())


def test_names_may_clash(spark):
    df = spark.createDataFrame([("x", 1, 2)], "v string, _original int, __replacement int")
    got = M.apply(df, "v", spark.createDataFrame([(None, "x", "y")], M.SCHEMA), None)
    assert got.columns == df.columns and got.first()[:3] == ("y", 1, 2)


def test_cli(spark, tmp_path, capsys):
    from maskframe import cli

    (tmp_path / "in").mkdir()
    for n in "ab":
        (tmp_path / f"in/{n}.sql").write_text(DUMP, encoding="utf-8")
    (tmp_path / "in/c.sql").write_text("INSERT INTO t VALUES (1, 'a');\n")
    assert cli.main([str(tmp_path / "in"), "-o", str(tmp_path / "out")]) == 1
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a_sanitized.sql", "b_sanitized.sql"]
    assert cli.main([str(tmp_path / "in/a.sql"), "--plan"]) == 0
    assert "Artist.Email: email  # " in capsys.readouterr().out


def test_rules_file():
    rules = parse_rules("# c\ntransforms:\n  A.b: name  # x\n  A.c: skip\noutput:\n  d: e\n")
    assert rules == {"A.b": "name", "A.c": "skip"}
    assert parse_rules(write_rules({("A", "b"): "name"})) == {"A.b": "name"}
    with pytest.raises(ValueError):
        parse_rules("transforms:\n  nonsense\n")


def test_engine_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, f"+1 (425) 555-01{i:02}", f"p{i % 3}@x.de", "abc"[i % 3]) for i in range(20)], "id int, tel string, mail string, kind string")
    engine = Engine(spark)
    types = engine.run({"t": df}, str(tmp_path / "out"))
    assert types["t", "tel"] == "phone" and types["t", "id"] == "skip"
    done = spark.read.parquet(str(tmp_path / "out/t"))
    assert done.columns == df.columns and done.join(df, ["id", "tel"]).count() == 0
    df.write.parquet(str(tmp_path / "in"))
    mapping = M.load(spark, str(tmp_path / "out/_mapping"))
    stream = streaming.mask_stream(engine, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t", types, mapping)
    q = stream.writeStream.format("memory").queryName("masked").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("masked").collect()} == {tuple(r) for r in done.collect()}
    grow = streaming.grow_mapping(spark, str(tmp_path / "grown"), "kind")
    grow(df.where("id < 2"), 0)
    grow(df, 1)
    got = pairs(streaming.versions(spark, str(tmp_path / "grown")))
    assert sorted(got) == sorted(got.values()) == ["a", "b", "c"]


def test_files(spark, tmp_path):
    import json

    from maskframe.sources import files

    (tmp_path / "a.sql").write_text("x" * 2048)
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "t_c_samples.json").write_text(json.dumps([{"value": "x"}, {"value": "y"}, {"value": "z"}]))
    (tmp_path / "profiles.json").write_text(json.dumps({"t_c": {"unique_count": 3}}))
    assert [(r["path"].rpartition("/")[2], r["length"]) for r in files.dumps(spark, str(tmp_path)).collect()] == [("a.sql", 2048)]
    assert files.size_text(2048) == "2 KB" and files.size_text(3 << 20) == "3.0 MB"
    assert str(files.output_path("x/a.sql", "out/profiles")) == "out/a_sanitized.sql"
    assert [r["value"] for r in files.samples(spark, str(tmp_path), "t_c", 2).collect()] == ["x", "y"]
    assert files.stats(spark, str(tmp_path), "t_c") == {"unique_count": 3.0} and files.stats(spark, str(tmp_path), "no") == {}
