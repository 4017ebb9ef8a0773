import random

import pytest
from loomgraph.operators import quads as Q
from loomgraph.sources import turtle


def odd_turtle(n: int) -> str:
    """Statements over several lines, long strings and comments whose lines look like ends, declarations on the way."""
    rnd, out = random.Random(7), ["@prefix : <urn:loomgraph:> . # a comment .", "@prefix x: <http://x/0#> ."]
    for k in range(n):
        out.append(
            [
                f":s{k} :p :o{k % 7} ;\n  :q 'it''s'.".replace("''", "\\'"),
                f':s{k} :long """first .\n@prefix x: <http://no/> .\n# no comment .\n\'\'\' "" {"line .\n" * (k % 40)}end""" .',
                f":s{k} :long '''second .\n\"\"\" .\n{'y .' + chr(10)}'''@en , \"a # b .\" .  # c .",
                f":s{k} :p ( :a \"b\" 1.5 ) ; :node [ a :Blank ;\n :q [] ] .",
                f"@prefix x: <http://x/{k}#> .\nx:a{k} :p x:b . # 'open",
                f":a{k} :p 5 . :b{k} :p\n# the rest comes .\n  <http://iri/#frag> . x:c{k} a x:D .",
                f"PREFIX y{k}: <http://y/{k}#>\ny{k}:a :p true .\n",
            ][rnd.randrange(7)]
        )
    return "\n".join(out) + "\n"


def test_one_file_in_many_blocks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "big.ttl").write_text(odd_turtle(900))
    (tmp_path / "t" / "small.ttl").write_text(":a :b :c . x:a :b [ :c :d ] .".replace("x:", ":x"))
    read = lambda: sorted(map(str, turtle.read(spark, f"file://{tmp_path}/t", "r").collect()))
    one = read()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        blocks = turtle._lines(spark, f"file://{tmp_path}/t").select("path", "start").distinct().count()
        many = read()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert blocks > 40 and many == one and len(one) > 2000

    # without blank nodes, whose names are the reader's, it is what the parser says of the whole text
    short = lambda x: x if x.startswith("_:") else turtle.shortened(x)
    whole = {(short(s), turtle.shortened(p), short(o) if k == "iri" else o, lang) for s, p, o, k, _, lang in turtle.parsed(odd_turtle(900)) if "_:" not in s + o}
    got = turtle.read(spark, f"file://{tmp_path}/t/big.ttl", "r", "g").filter("s not like '\\\\_:%' and o not like '\\\\_:%'").select("s", "p", "o", "o_lang").collect()
    assert {tuple(r) for r in got} == whole


def test_blocks_fail_as_files_do(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        (tmp_path / "bad.ttl").write_text(":a :b :c .\n" * 300 + ":a :b\n" + ":a :b :c .\n" * 300)
        with pytest.raises(Exception, match="bad.ttl, after line 300: expected"):
            turtle.read(spark, f"file://{tmp_path}/bad.ttl", "r").collect()
        (tmp_path / "split.ttl").write_text("@prefix z:\n <http://z/> .\n" + ":a :b z:c .\n" * 300)
        with pytest.raises(turtle.TurtleError, match="several lines"):
            turtle.read(spark, f"file://{tmp_path}/split.ttl", "r").collect()
        (tmp_path / "none.ttl").write_text("")
        assert turtle.read(spark, f"file://{tmp_path}/none.ttl", "r").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert turtle.read(spark, f"file://{tmp_path}/split.ttl", "r").count() == 1  # one block takes it


def test_written_in_parts(spark, tmp_path):
    rows = [("r", "g", f":s{k:05d}", ":p", f'x "{k}"\n.', "lit", None, None) for k in range(3000)]
    q = Q.quads(spark.createDataFrame(rows, turtle.KEY_SCHEMA).repartition(4))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turtle.write(q, f"file://{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    assert {tuple(r) for r in turtle.read(spark, f"file://{tmp_path}/out", "r", "g").collect()} == {tuple(r) for r in q.collect()}
