"""Edge cases of the chat, language and token operators, and the columns of every query."""

from __future__ import annotations

import random

import brute
import duckdb
import pytest

from velario.llm import chat, lang_id, queries, token_count


def part(**x):
    return tuple(x.get(f) for f in chat.PART.names)


def test_odd_parts(spark):
    nan = float("nan")
    parts = [part(kind="video", ref="v"), part(ref="n", text="lost"), None, part(kind="audio", seconds=nan), part(kind="audio", seconds=float("inf")), part(kind="audio", seconds=-3.0), part(kind="image", width=-5), part(kind="document", pages=0), part(kind="text"), part(kind="attach", ref="h")]
    rows = [(None, 0, "user", parts), (None, 0, "user", parts), (None, None, None, [])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<" + chat.PART.simpleString() + ">")
    (r,) = chat.format_conversations(df).collect()
    kinds = ["part", "part", "audio", "audio", "audio", "image", "document", "part"]
    assert r["conv_id"] is None and [a["kind"] for a in r["attachments"]] == kinds * 2
    assert [a["tokens"] for a in r["attachments"]][:8] == [0, 0, 0, 0, 0, 170, 600, 0]
    assert r["formatted"].startswith("<|im_start|>\n<|im_end|>\n<|im_start|>user\n<|part:0|><|part:1|><|audio:2|>")


def test_equal_turns_and_extra_columns(spark):
    rows = [(1, 0, "assistant", "x", 5, 6), (1, 0, "assistant", "x", 5, 6), (None, 0, "user", None, 5, 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts int, formatted int")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(chat.with_text_parts(df)).collect()}
    one = "<|im_start|>assistant\nx<|im_end|>\n"
    assert got == {1: one * 2, None: "<|im_start|>user\n<|im_end|>\n"}


def test_sample_of_languages(spark):
    """The share of a label's rows is right for counts that no integer share could express."""
    rows = spark.range(200_000)
    for n, quota in ((200_000, 4000), (10**10, 2 * 10**9), (10**10, 500)):
        want = 200_000 * quota / n
        got = rows.where(lang_id.picked(rows["id"], rows["id"] * 0 + n, quota)).count()
        assert abs(got - want) <= 5 * want**0.5 + 1


def test_many_languages(spark):
    """Every label is learned, however many there are."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in rng.choices("xyzw", k=12)), f"l{k}") for i, k in enumerate(rng.choices(range(260), k=3000))]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=3000)
    assert len(model.languages) == len({r[2] for r in rows if r[0] is not None}) == 260


def test_long_texts(spark):
    long = "the thing " * 400_000
    docs = spark.createDataFrame([(1, long, "en", 1), (1, long, "en", 1), (3, None, None, None), (4, "a thing", "en", 1), (6, "der und", "de", 1)], "doc_id long, text string, lang string, __text int")
    assert {(r["doc_id"], r["n_tokens"]) for r in token_count.token_counts(docs).collect()} >= {(3, 0), (1, token_count.counter(token_count.DEFAULT_VOCABULARY).count(long))}
    got = lang_id.predict(docs, lang_id.train(docs)).collect()
    assert len(got) == 5 and {r["lang_pred"] for r in got if r["doc_id"] == 3} == {"und"}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The tables of the queries with odd rows and columns that the queries do not know."""
    path = tmp_path_factory.mktemp("small")
    docs = {1: "alpha beta " * 40, 2: "alpha beta " * 40, 3: None, 4: "", 5: "mail a@b.co token=x9Kq7Zp3Lw 1.2.3.4 " + "f" * 24, 6: "el la de una cosa", 7: "a benchmark passage that nobody should learn from"}
    rows = [(i, t, ("en", "es", None)[i % 3], "s", len(t or ""), 1, 2, 3) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hits int, spans int, copies int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, docs[7])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "hi", 1), (1, 1, "assistant", None, 1)], "conv_id long, turn long, role string, text string, parts int").write.parquet(f"{path}/conversations.parquet")
    return str(path), docs


COLUMNS = {
    "op1_language_id": "doc_id held_out lang_pred score",
    "op2_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op3_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op4_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op5_near_dedup": "doc_id n_shingles component_id kept",
    "op7_mixing": "doc_id size source_size target taken",
    "op8_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op10_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_columns(spark, small, name):
    path, docs = small
    got = queries.QUERIES[name](spark, path)
    rows = got.collect()
    assert set(COLUMNS.get(name, "").split()) <= set(got.columns)
    assert len(rows) == {"op2_chat_format": 2, "chat_typed_parts": 1, "mixing_targets": 1}.get(name, len(docs))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, small, name):
    """Odd rows too: nulls, empty texts, copies and unknown columns."""
    path, _ = small
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.execute(f"create view {table} as select * from read_parquet('{path}/{table}.parquet/*.parquet')")
    found = duck.execute(queries.ORACLES[name])
    heads = [d[0] for d in found.description]
    want = [dict(zip(heads, r, strict=True)) for r in found.fetchall()]
    got = queries.QUERIES[name](spark, path)
    assert sorted(heads) == sorted(got.columns)
    plain = lambda rows: sorted(str([r[c] for c in sorted(heads)]) for r in rows)
    assert plain(got.collect()) == plain(want)


def test_query_digests(spark, small):
    """The digest columns against the plain versions."""
    path, docs = small
    rows = lambda name: {r["doc_id"]: r for r in queries.QUERIES[name](spark, path).collect()}
    for name, plain in (("op4_pii", brute.pii), ("op10_secrets", brute.secrets)):
        for i, r in rows(name).items():
            assert r["base_sha256"] == brute.sha(brute.joined(plain(docs[i])))
            assert [s for s in r["spans"].split(",") if s.split(":")[0] in [k for k, _, _ in plain(docs[i])]] == [f"{k}:{a}:{b}" for k, a, b in plain(docs[i])]
            assert len(r["scores"].split(",")) == len(r["spans"].split(","))
    want = brute.substring(docs)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in rows("op3_substring_dedup").items()} == want
    told = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.op2_chat_format(spark, path).collect()}
    assert got == brute.chat(told)
