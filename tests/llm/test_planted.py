"""Planted cases: how many of them each operator finds, at least nine in ten."""

import random

import pytest

from tidemark.llm import codetext, credentials, doclang, syntax

HELD_OUT = {
    "en": "Nobody expected the river to freeze before the children came home from their grandmother.",
    "de": "Niemand hatte erwartet, dass der Fluss zufrieren würde, bevor die Kinder von ihrer Großmutter kamen.",
    "fr": "Personne ne s'attendait à ce que la rivière gèle avant que les enfants rentrent de chez leur grand-mère.",
    "es": "Nadie esperaba que el río se helara antes de que los niños volvieran de la casa de su abuela.",
    "pt": "Ninguém esperava que o rio congelasse antes de as crianças voltarem da casa da avó delas.",
    "it": "Nessuno si aspettava che il fiume gelasse prima che i bambini tornassero dalla casa della nonna.",
    "nl": "Niemand had verwacht dat de rivier zou bevriezen voordat de kinderen van hun grootmoeder terugkwamen.",
    "sv": "Ingen hade väntat sig att floden skulle frysa innan barnen kom hem från sin mormor.",
    "pl": "Nikt się nie spodziewał, że rzeka zamarznie, zanim dzieci wrócą do domu od swojej babci.",
    "tr": "Çocuklar büyükannelerinden eve dönmeden önce nehrin donacağını hiç kimse beklemiyordu ve bu çok garipti.",
    "ru": "Никто не ожидал, что река замёрзнет раньше, чем дети вернутся домой от своей бабушки.",
}


def test_credentials_planted():
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    forms = ['password = "{}"', "client_secret: '{}'", "export API_KEY={}", "jdbc:postgresql://h/x?user=a&password={}&ssl=true", "https://bot:{}@git.example.org/x.git", "Authorization: Bearer {}", '{{"accessToken": "{}"}}', "<password>{}</password>", "login('ops', '{}')", "the old password was '{}'"]
    hosts = ["for (int i = 0; i < 10; i++) {{ run(i); }}\n{}\nreturn total;", "2026-01-01 INFO boot\n{}\n2026-01-01 INFO done", "# settings\nport: 8080\n{}\n"]
    texts, want = [], []
    for _ in range(400):
        value = word(rnd.randrange(12, 40)) + str(rnd.randrange(10))
        texts.append(rnd.choice(hosts).format(rnd.choice(forms).format(value)))
        want.append((len(want), texts[-1].index(value), texts[-1].index(value) + len(value)))
    got = credentials.Scanner().scan(texts)
    assert len(set(got) & set(want)) >= 0.95 * len(want) and len(set(got) & set(want)) >= 0.95 * len(got)


def test_languages_planted(spark):
    rows = [(i, 1, f"// {text}", None, None) for i, text in enumerate(HELD_OUT.values())] + [(100 + i, 1, None, x, f'"{x}"') for i, x in enumerate(["SELECT id FROM accounts", "/api/v1/{id}", "--offset=52 --cursor", "com.example.app.Service", "%s-%d items", "a b c d e"])]
    got = {r.span_id: r.lang for r in codetext.span_languages(spark.createDataFrame(rows, "span_id long, file_id long, comment_text string, literal_value string, raw_text string")).collect()}
    assert sum(got.get(i) == code for i, code in enumerate(HELD_OUT)) >= 10 and not [k for k in got if k >= 100]


def test_paragraphs_planted(spark):
    text = "\n\n".join(HELD_OUT.values())
    got = {r.seg_no: r.lang for r in doclang.paragraph_languages(spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string"), doclang.Judge({})).collect()}
    assert sum(got.get(i) == code for i, code in enumerate(HELD_OUT)) >= 10


@pytest.mark.parametrize("lang", ["java", "ts", "sql", "py", "json", "yaml", "xml"])
def test_damage_planted(sf, lang):
    """Files of the data that are valid stay so; with conflict marks, a cut or an unclosed bracket nearly all are refused."""
    import duckdb

    rows = duckdb.connect().sql(f"SELECT lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)), file_content FROM '{sf.replace('sf0.001', 'sf0.01')}/model_files.parquet' WHERE file_content IS NOT NULL").fetchall()
    valid = [t for e, t in rows if syntax.LANGUAGE_OF.get(e) == lang and len(t) > 60 and syntax.failure(lang, t) is None]
    assert len(valid) > 10
    rnd = random.Random(2)
    found = tried = 0
    for t in valid:
        lines = t.splitlines()
        at = rnd.randrange(len(lines))
        damaged = ["\n".join([*lines[:at], "<<<<<<< HEAD", *lines[at : at + 1], "=======", *lines[at : at + 1], ">>>>>>> other", *lines[at + 1 :]])]
        if lang in ("java", "json", "xml"):
            damaged.append(t.rstrip()[: -1 if lang != "xml" else -2])
        for d in damaged:
            tried += 1
            found += syntax.failure(lang, d) is not None
    assert found >= 0.9 * tried
