import json

import pytest

from etalase.functions.prompt import template
from etalase.operators import comparison
from plans import plan_text
from test_catalog import TYPES


@pytest.fixture(scope="module")
def shop(spark):
    rows = [
        ("a", "Tas Kulit Hitam", 225000, 3, 0, 4.5),
        ("b", "Tas Kanvas", 110000, 3, 12, None),
        ("c", "Kursi", None, 3, 5, 5.0),
        ("d", "Tas Kanvas", 90000, 3, 1, 3.0),
        ("e", None, 1, 1, 1, 1.0),
        ("twice", "Meja", 1, 1, 1, 1.0),
        ("twice", "Meja", 2, 1, 1, 1.0),
    ]
    tail = (None, "Rumah", "Merk", 1, 100, "10 x 10", "Kota", "Toko", "bagus")
    return spark.createDataFrame([(*r, *tail) for r in rows], TYPES)


def asked(spark, **requests):
    df = spark.createDataFrame(list(requests.items()), "request_id string, product_ids array<string>")
    return comparison.request_items(df)


def test_validation(spark, shop):
    items = asked(
        spark,
        one=["a"],
        two=["a", "b"],
        three=["c", "b", "a"],
        four=["a", "b", "c", "d"],
        many=["a"] * 1000,
        same=["a", "a"],
        unknown=["a", "nobody"],
        repeated=["a", "twice"],
        makes_up=["twice", "nobody"],
        empty=[],
        none=None,
        hole=["a", None],
    )
    got = {r.request_id: (r.valid, r.reason) for r in comparison.validate_requests(items, shop).collect()}
    assert got == {
        "one": (False, "size"),
        "two": (True, None),
        "three": (True, None),
        "four": (False, "size"),
        "many": (False, "size"),
        "same": (False, "duplicate_id"),
        "unknown": (False, "unknown_id"),
        "repeated": (False, "repeated_product"),
        "makes_up": (False, "unknown_id"),
        "empty": (False, "size"),
        "none": (False, "size"),
        "hole": (False, "unknown_id"),
    }
    groups = comparison.comparison_groups(items, shop).collect()
    assert {g.request_id: [p.product_id for p in g.products] for g in groups} == {
        "two": ["a", "b"],
        "three": ["c", "b", "a"],
    }


def test_groups_carry_what_is_asked_for_and_look_at_each_item_once(spark, shop):
    items = asked(spark, r=["b", "c"], one=["a"], same=["a", "a"], unknown=["a", "nobody"])
    groups = comparison.comparison_groups(items, shop, ["product_name"])
    assert [[p.asDict() for p in g.products] for g in groups.collect()] == [
        [{"place": 0, "product_id": "b", "product_name": "Tas Kanvas"}, {"place": 1, "product_id": "c", "product_name": "Kursi"}]
    ]
    # Refused requests are not worked out a second time just to be dropped.
    assert "Union" not in plan_text(comparison.comparison_groups(items, shop))
    responses = spark.createDataFrame(
        [("r", json.dumps({"choices": [{"message": {"content": "Saya rekomendasikan **Kursi** Untuk anda beli Karena kuat"}}]}))],
        "request_id string, response_json string",
    )
    full, narrow = (
        comparison.comparison_answers(comparison.comparison_groups(items, shop, c), responses).collect()
        for c in (None, ["product_name"])
    )
    assert full == narrow and full[0].best_product_id == "c"


def test_prompt(spark, shop):
    groups = comparison.comparison_groups(asked(spark, r=["b", "c"]), shop)
    text = template(assistant="Budi", greeting="Halo Kawan")
    messages = comparison.comparison_prompts(groups, text).collect()[0].messages
    assert [m.role for m in messages] == ["user"]
    prompt = messages[0].content
    assert prompt.startswith("KONSISTEN JIKA") and "bernama Budi," in prompt
    assert "\n\nHalo Kawan!\n\n" in prompt and prompt.endswith("Jangan Lupa Checkout")
    assert (
        "akan dibandingkan:\nNama Produk: Tas Kanvas\nRating: None\nDeskripsi: bagus\n"
        "Harga: Rp110000\nJumlah Terjual: 12\nKategori: Rumah\nMinimal Pembelian: 1\n"
        "Dimensi Ukuran: 10 x 10\nPenjual: Toko\n\nNama Produk: Kursi\n"
    ) in prompt
    assert "Harga: RpNone\n" in prompt


LINE = "Saya rekomendasikan {} Untuk anda beli Karena {}"


@pytest.mark.parametrize(
    ("ids", "answer", "best"),
    [
        # Bold name, exactly.
        (["a", "b"], LINE.format("**Tas Kanvas**", "murah"), "b"),
        # Most words; the bold text is no product name.
        (["b", "a"], LINE.format("**Produk A: TAS KULIT hitam**", "awet"), "a"),
        # First of equal scores.
        (["a", "b", "c"], LINE.format("tas", "ok"), "a"),
        (["b", "a", "c"], LINE.format("tas", "ok"), "b"),
        # Words count inside other words, and in the reason.
        (["c", "a"], LINE.format("itu", "perkursian"), "c"),
        # Equal names: the last id by words, the first by bold name.
        (["b", "d"], LINE.format("tas kanvas", "ok"), "d"),
        (["b", "d"], LINE.format("**Tas Kanvas**", "ok"), "b"),
        # No word, no line, a line cut in two.
        (["a", "c"], LINE.format("itu", "mmm"), None),
        (["a", "c"], "Tidak ada.", None),
        (["a", "c"], LINE.format("Kursi\n", "ok"), None),
        # A bold name counts without the rest of the line; an empty one does not.
        (["a", "c"], "Saya rekomendasikan **Kursi** saja", "c"),
        (["a", "c"], LINE.format("****", "kulit"), "a"),
        # Only the first line is read; other line marks do not end it.
        (["a", "c"], LINE.format("Kursi", "x") + "\n" + LINE.format("Tas Kulit Hitam", "x"), "c"),
        (["a", "c"], LINE.format("itu Kursi", "x"), "c"),
        # A product without a name cannot win.
        (["e", "c"], LINE.format("None kursi", "x"), "c"),
    ],
)
def test_answers(spark, shop, ids, answer, best):
    groups = comparison.comparison_groups(asked(spark, r=ids), shop)
    body = json.dumps({"choices": [{"message": {"content": answer}}, {"message": {"content": "no"}}]})
    responses = spark.createDataFrame([("r", body), ("other", body)], "request_id string, response_json string")
    got = comparison.comparison_answers(groups, responses).collect()
    assert [tuple(r) for r in got] == [("r", answer, best)]
