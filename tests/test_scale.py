"""What the verifiers and parsers send and hold, so that their cost follows the input."""

import numpy as np
import pytest

from bytemill.functions import hexdump, standins
from bytemill.operators import collection, datasets, listing, profile


def joined(rows):
    """The names of all columns that come into a join."""
    found, nodes = set(), [rows._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        kids = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            found |= {kid.output().apply(i).name() for kid in kids for i in range(kid.output().size())}
        nodes += kids
    return found


def test_dialects_share_their_tokens(monkeypatch):
    """Five dialects search the text for words twice at most; counts need no array and agree with those beside one."""
    calls, words = [], hexdump._words
    monkeypatch.setattr(hexdump, "_words", lambda *a: (calls.append(1), words(*a))[1])
    texts = [b"00401000 4D 5A ?? zz", b"", b"4D5A\n00401010 90 1", b"7F 45\n"]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    tokens = hexdump._Tokens(data, offs)
    for d in hexdump.DIALECTS:
        whole, counts = (hexdump._parsed(tokens, d, values) for values in (True, False))
        assert whole.flatten()[1:] == counts.flatten()
        assert [len(x) for x in whole.field("values").to_pylist()] == counts.field("n_total").to_pylist()
    assert len(calls) == 2


def test_counts_leave_no_text_or_array(spark):
    rows = spark.createDataFrame([(1, "00401000 4D zz"), (2, None)], "id long, t string")
    out = hexdump.with_parsed(rows, "t", {"x": "extract"}, values=False, keep=False)
    assert out.columns == ["id", "x"] and "values" not in out.schema["x"].dataType.names
    assert sorted(out.select("id", "x.n_total", "x.n_known", "x.n_invalid", "x.rejected").collect()) == [(1, 2, 1, 1, False), (2, 0, 0, 0, False)]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 32, 1000])
def test_dumps_of_any_length(spark, n, tmp_path):
    """Each line's address and bytes, between two other texts."""
    spark.createDataFrame([(1, None), (2, "ab" * n), (3, "c")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    told = {r.doc_id: r.dump for r in profile.dumps(spark, str(tmp_path)).collect()}
    cells = ["??" if (62 + i) % 17 == 0 else "zz" if (62 + i) % 97 == 1 else "61" if i % 2 == 0 else "62" for i in range(2 * n)]
    assert told[2] == "\n".join(f"{0x401000 + i:08X} {' '.join(cells[i : i + 16])}" for i in range(0, 2 * n, 16))
    assert told[1] == "" and told[3] == "00401000 63"


@pytest.mark.parametrize("query", [datasets.dump_digests_query, datasets.dump_expectations])
def test_no_dump_is_joined(spark, query):
    """A dump is more than three times its document: only its counts and digests go through a shuffle."""
    names = joined(query(spark, "/root/testdata/sf0.001"))
    assert "doc_id" in names and not names & {"dump", "text"}


def test_no_image_is_joined(spark, monkeypatch):
    """Images and masks are read, hashed and measured where they lie: joins get hashes only."""
    seen, collisions = [], collection.collisions
    monkeypatch.setattr(collection, "collisions", lambda rows, key: (seen.append(joined(rows)), collisions(rows, key))[1])
    found = collection.stored_collection(spark, "/root/testdata/sf0.001")
    assert not joined(found["images"]) and not joined(found["masks"])
    collection.image_report(found["manifest"], found["images"], found["masks"], collection.SETTINGS)
    assert len(seen) == 1 and "path" in seen[0] and not seen[0] & {"data", "pixel", "mask"}
    paths = found["images"].select("id", "path").join(found["manifest"], "id")
    assert paths.filter("path = image_path").count() == paths.count() == found["manifest"].count() > 0


def test_split_of_rows_in_place(spark):
    """The cuts of each class give every row the split that its rank gives; a row without an id has none."""
    at = "/root/testdata/sf0.01"
    ids = standins.documents(spark, at).select("doc_id", standins.sample_class().alias("class"))
    odd = spark.createDataFrame([(None, None)], ids.schema)
    assert sorted(standins.with_split(ids.unionByName(odd), spark, at).collect()) == sorted(standins.splits(spark, at).select("doc_id", "class", "split").collect())


def test_a_listing_is_matched_three_times(spark):
    """However many sections and mnemonics are counted; names that may match where others do are counted by themselves."""
    text = ".text:00401000 8B EC mov eax\nheader:.text:\n.text:00401001 90 nop\nextrn proc proc\na:b:\n"
    rows = spark.createDataFrame([(text,), (None,)], "t string")
    plan = listing.profile(rows, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 3 and "regexp_count(" not in plan and "filter(" not in plan
    row = listing.profile(rows, "t", ("mov", "nop"), (".text", "header", "a", "a:b")).first()
    assert (row.n_proc, row.n_extrn, row.opcode_count_mov, row.opcode_freq_nop) == (2, 1, 1, 0.5)
    assert (row.section_lines_text, row.section_lines_header, row["section_lines_a"], row["section_lines_a:b"]) == (2, 1, 1, 1)
