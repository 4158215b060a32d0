"""Names of emoji: by table, by rule and from the published list's form; the cleaning chain over a whole table."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkwell.functions import cleaning, emoji

# Published names of forms that are put together by rule.
RULES = {
    "❤️": "red heart", "❤": "red heart", "\U0001F44B\U0001F3FB": "waving hand light skin tone", "\U0001F9D4\U0001F3FC": "person medium-light skin tone beard",
    "\U0001F926‍♂️": "man facepalming", "\U0001F937\U0001F3FF‍♀️": "woman shrugging dark skin tone", "\U0001F46F‍♂️": "men with bunny ears",
    "*️⃣": "keycap *", "\U0001F1E8\U0001F1EE": "Côte d’Ivoire", "\U0001F1E6\U0001F1EC": "Antigua & Barbuda", "\U0001F1F1\U0001F1E8": "St. Lucia", "\U0001F600": "grinning face",
    "\U0001F3F4\U000E0067\U000E0062\U000E0073\U000E0063\U000E0074\U000E007F": "Scotland", "\U0001F55C": "one-thirty", "\U0001F567": "twelve-thirty", "\U0001F3FE": "medium-dark skin tone",
}
PLAIN = ["", "5 # *", "a‍b", "x️", "\U0001F1FA alone", "日本 naïve ½", "⃣"]


@pytest.fixture(scope="module")
def flags(spark):
    return emoji.regions(spark)


def test_tables_and_rules(flags):
    name = emoji.namer(emoji.named(), flags)
    assert len(emoji.named()) + len(RULES) > 200
    for s, n in [*emoji.named().items(), *RULES.items()]:
        token = emoji.token(n.replace(": ", " ")) if n.startswith("person:") else emoji.token(n)
        assert name(f"a{s}b") == f"a{token}b", (s, n)
    assert name("".join(RULES)) == "".join(emoji.token(n) for n in RULES.values())
    assert [name(t) for t in PLAIN] == PLAIN


def test_the_published_list_names_what_rules_do_not():
    lines = ["# comment", "1F469 200D 1F4BB ; fully-qualified # x E4.0 woman technologist", "1F1E6 1F1F6 ; fully-qualified # x E2.0 flag: Antarctica", "2764 FE0F 200D 1F525 ; fully-qualified # x E13.1 heart on fire"]
    name = emoji.namer(emoji.published(lines), {})
    assert name("\U0001F469‍\U0001F4BB❤‍\U0001F525\U0001F1E6\U0001F1F6") == ":woman_technologist::heart_on_fire::Antarctica:"
    assert emoji.namer(emoji.named(), {})("\U0001F469‍\U0001F680") == ":woman:‍:rocket:"  # no name as a whole


def _clean(text, name):
    for c in cleaning.INVISIBLE:
        text = text.replace(c, "")
    text = name(unicodedata.normalize("NFKC", text.translate(str.maketrans(cleaning.CONFUSABLE, cleaning.CONFUSABLE_LATIN))))
    if "</think>" in text:
        text = text.split("</think>")[1].strip()
    paras = [p for p in text.split("\n") if p.strip()]
    if len(paras) > 1 and any(re.sub("^[^a-zA-Z0-9]*", "", paras[0]).startswith(h) for h in cleaning.HEADER_STARTS):
        text = "\n".join(paras[1:])
    return re.sub(r"\s+", " ", text.lower()).strip()


def test_the_whole_chain_over_a_whole_table(spark, sf_dir, flags):
    name, forms = emoji.namer(emoji.named(), flags), [*emoji.named(), *RULES, "Sure!\n", "</think>", "ﬁ Ｘ раѕ​", "© ™"]
    form = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("doc_id") % len(forms) + 1).cast("int"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(form, "text", form).alias("text"))
    got = cleaning.clean_text(docs, "text", "clean").select("text", "clean").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.clean == (None if r.text is None else _clean(r.text, name))


def test_python_sees_only_rows_that_need_it(spark):
    rows = spark.createDataFrame([("plain",), ("&amp; <b>x</b>",), (None,), ("✅",)], "t string")
    assert [r[0] for r in rows.select(cleaning.harden(F.col("t"))).collect()] == ["plain", "&amp; <b>x</b>", None, ":check_mark_button:"]
    assert [r[0] for r in rows.select(cleaning.plain_markdown(F.col("t"))).collect()] == ["plain", "& x", None, "✅"]
