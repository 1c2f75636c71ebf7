import random

import pandas as pd

from tarnflow.llm import leaks, linkage, scans, sentences

NAMES = ["Stobrex", "Vandrith", "Kelmoor", "Drasnick", "Pologwen", "Hythrand", "Zemlukar", "Wystrell"]


def passage(rng):
    a, b, c = rng.sample(NAMES, 3)
    return f"The basin of {a}{rng.randint(10, 99)} Lake holds water to a depth of {rng.randint(1, 99)}.{rng.randint(1, 9)} m at the inlet. According to {b}ova et al. ({rng.randint(1970, 2020)}), turbidity rose under low flow. We sampled {c} Pond on {rng.randint(1, 28)} May {rng.randint(1970, 2020)}."


def test_winnowing_keeps_a_print_of_every_long_span():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("abcdefgh") for _ in range(300))
        at = rng.randint(0, 200)
        span = text[at : at + 17]
        other = "x" * 40 + span + "y" * 40
        assert set(leaks.fingerprints(text, 10, 8)[0]) & set(leaks.fingerprints(other, 10, 8)[0])
    assert len(leaks.fingerprints("short", 10, 8)[0]) == 0


def test_leaks_whole_partial_changed_and_not(spark):
    rng = random.Random(2)
    items = [(i, passage(rng)) for i in range(20)] + [(90, None), (91, ""), (0, None)]
    text = dict(items[1:20])
    half = text[3][: int(len(text[3]) * 0.7)]
    third = text[4].split(". ")[2]
    changed = text[5].replace("holds water to a depth", "held water at a depth").upper()
    names = text[6].replace("Lake", "Lake").translate(str.maketrans("0123456789", "1234567890"))
    spread = text[7].replace(". According", '.\n</page>\n<page number="4">\n\nAccording').replace("fl", "ﬂ").replace(" ", "  ")
    docs = [(1, text[2]), (2, "Other words. " * 50 + half), (3, third), (4, changed), (5, names), (6, spread), (7, None), (8, ""), (9, "filler " * 100_000 + text[8] + " filler" * 1000), (1, text[2])]
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'clash' as item_id"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 2), (1, 2), (2, 3), (4, 5), (6, 7), (9, 8)]
    blocks = leaks.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), settings=leaks.Settings(broadcast_chars=0))
    assert sorted((r.doc_id, r.item_id) for r in blocks.collect()) == [(1, 2), (1, 2), (2, 3), (4, 5), (6, 7), (9, 8)]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), none).count() == 0


def test_blocks_leave_out_markup_and_part_lists():
    text = '<page number="0">\n2. Methods\n\nA line\nwraps here. Next.\n\n- one\n- two\n  more\n\n<table number="1"><tr><td>x. y</td></tr></table>\n</page>'
    assert [(text[a:b], k) for a, b, k in sentences.blocks(text)] == [("2. Methods", "heading"), ("A line\nwraps here. Next.", "text"), ("- one", "entry"), ("- two\n  more", "entry")]
    assert sentences.blocks("") == [] and sentences.blocks(" \n ") == []


def test_sentences_of_many_scripts(spark, small):
    docs = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    model = sentences.train(sentences.lay_out(docs, "doc_id", "text", False))
    # without marks, in one case, and in a script without blanks
    plain = ["plankton was highest before ice cover formed", "total conductivity peaked despite repeated dredging", "we sampled the eastern shore of the pond in may", "no relation between oxygen and nitrogen was found"]
    text = " ".join(plain)
    assert [text[a:b] for a, b in sentences.units(text, model)] == plain
    plain = ["浮游植物在枯水期间上升了七倍而沉积物保持不变", "水生植物在清淤以后覆盖了约八成的水面", "记录中写道水很清"]
    assert len(sentences.units("".join(plain * 2), model)) > 2  # longer than a heading
    cases = [
        ["According to Brevik et al. (1999), it rose.", "Mean depth was 4.5 m, i.e. less than all.", "“Why is it so?” asked Mrs. Tarn when plankton peaked."],
        ["Am 1. Mai 1983 wurden im Beflovemweiher 20 Proben entnommen, z. B. am Zulauf.", "Warum blieb das Wasser von Dyklidwem bei Niedrigwasser so klar?"],
        ["溶解氧在夏末上升了66.4倍……而透明度保持不变。", "“这里的水从不结冰。”Loplelathescu在1968年这样写道！", "Glyslykal湖在结冰之前的最大水深为72.8米。"],
        ["पानी साफ है।", "क्या Nyspikly का pH 6.1 था?"],
        ["Τα μακρόφυτα κάλυπταν 52,7% της επιφάνειας· το άζωτο έμεινε σταθερό!", "Γιατί μειώθηκε ο φώσφορος στο Snabrystind;", "Το 1981 μετρήθηκαν 42 έλη, π.χ. κοντά στο Bralatendfield."],
        ["يبلغ عمق بحيرة Trigaspen نحو 13.2 متر.", "لماذا انخفض الفوسفور في بركة Dweklidom؟"],
        ["ความลึกสูงสุดของบึง Pidakal คือ 92.5 เมตร", "พืชน้ำปกคลุมพื้นที่ 13 เปอร์เซ็นต์ของผิวน้ำ"],
    ]
    for want in cases:
        text = ("" if "。" in want[0] or "！" in want[-1] else " ").join(want)
        assert [text[a:b] for a, b in sentences.units(text, model)] == want


def test_buckets_belong_to_their_most_frequent_word(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, " ".join(passage(rng) for _ in range(3))) for i in range(60)], "doc_id int, text string")
    whole = sorted((r.doc_id, r.end_pos) for r in sentences.split_sentences(df).collect())
    assert len(whole) >= 180
    parts = df.where("doc_id < 30").unionByName(df.where("doc_id >= 30").repartition(7))
    assert sorted((r.doc_id, r.end_pos) for r in sentences.split_sentences(parts, with_text=False).collect()) == whole
    counts = sentences.Counts()
    counts.put(pd.DataFrame({"c": [sentences.LEFT] * 2, "h": [5, 7], "shape": [3, 4], **{f"n{k}": [2.0, 3.0] for k in range(4)}}))
    assert counts.tables[sentences.LEFT, sentences.SITE_COUNT][5] == 2 and counts.owner[sentences.LEFT][5] == 1 and counts.owner[sentences.LEFT][6] == 0


def test_units_cover_the_text_and_empty_tables(spark):
    rng = random.Random(3)
    texts = [" ".join(passage(rng) for _ in range(rng.randint(1, 4))) for _ in range(30)]
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "   "), (103, "no mark at all"), (104, "word " * 60_000 + "end."), (None, "x.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as unit_no", "'c' as sentence")
    got = {}
    for r in sentences.split_sentences(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert not {100, 101, 102, None} & set(got) and len(got[103]) == 1
    for i, t in rows:
        if i in got:
            units = sorted(got[i], key=lambda r: r.start_pos)
            assert "".join(r.sentence for r in units).replace(" ", "") == t.replace(" ", "")
            assert all(t[r.start_pos : r.end_pos] == r.sentence for r in units) and [r.unit_no for r in units] == list(range(len(units)))
    assert sentences.split_sentences(df.where("false")).count() == 0


def test_scans_are_repaired(spark):
    rng = random.Random(4)
    words = ["nitrogen", "depth", "water", "sediment", "respiration", "the", "of", "pond", "was", "low-flow", "station", "close", "measured", "following"]
    clean, noisy, cases = [], [], set()
    for paper in range(40):
        for k in range(3):
            page, cid = 10 * paper + k, len(noisy)
            body = [[rng.choice(words) for _ in range(8)] for _ in range(12)]
            body[-1][-1] += "."
            lines = [" ".join(x) for x in body]
            if paper < 20:
                if k:
                    i = rng.randint(0, 10)
                    lines[i] = lines[i] + " respi-"
                    lines[i + 1] = "ration " + lines[i + 1]
                    cases.add((cid, i + 3, "hyphen", "respiration"))
                    j = (i + 5) % 11
                    lines[j] = lines[j] + " wa5 n1trogen 2l.5"[:4] + ""
                    cases.add((cid, j + 3, "misread", "was"))
                lines = [["Snifus et al.", "SNIFUS ET AL.", "Snifus  et  al."][k], "", *lines, f"- {page} -"]
                cases |= {(cid, 1, "header", ""), (cid, len(lines), "page_no", "")}
            else:
                lines = ["", "", *lines]
            noisy.append((cid, f"W{paper}", page, "\n".join(lines)))
    df = spark.createDataFrame([*noisy, (900, "W9", 3, None), (901, None, None, ""), (None, "W1", 1, "x")], "context_id bigint, document_id string, page_number int, context string").selectExpr("*", "'clash' as line", "1 as kind")
    found, lines = scans.repair(df)
    got = {(r.context_id, r.line_no, r.kind, r.word) for r in found.collect()}
    assert len(got & cases) / len(cases) > 0.97 and len(got & cases) / len(got) > 0.97
    paragraphs = {r.context_id: r.text for r in scans.paragraphs(lines).where("paragraph_no = 1").collect()}
    assert "respiration" in paragraphs[1] and "respi-" not in paragraphs[1] and "et al" not in paragraphs[1] and "wa5" not in paragraphs[1]
    empty, _ = scans.repair(df.where("false"))
    assert empty.count() == 0


def test_names_and_places_are_parsed():
    generic = linkage.Generic(["old", "lake", "pond", "pd", "mill", "little", "ponds"])
    assert linkage.split_name("Old Vrefoslim Pd", generic) == ("vrefoslim", ["old", "pd"])
    assert linkage.split_name("Láke  Brèplibom", generic) == ("breplibom", ["lake"])
    assert linkage.split_name("Drarhywes Mill Pnod (DR17)", generic) == ("drarhywes", ["mill", "pond"]) and linkage.name_code("Drarhywes Mill Pond (DR17)") == "dr17"
    assert linkage.only_code("KO37") and linkage.only_code(' "ko 37", ') and not linkage.only_code("Lake 37") and not linkage.only_code(None)
    assert linkage.split_name("Little Lelusnim Lake 2", generic) == ("lelusnim", ["#2", "lake", "little"]) and linkage.split_name(None, generic) == (None, [])
    assert linkage.split_name("Old Mill Pond", generic) == ("oldmillpond", [])
    assert linkage.near("pnod", "pond") and linkage.near("upper", "upper") and linkage.near("uppe", "upper") and not linkage.near("lakes", "lake") and not linkage.near("fen", "bog")
    assert linkage.parse_places("near Kesmoor; northern Town / X district") == ["kesmoor", "town", "x"]
    assert "kesmoor" in linkage.title_places("Water survey of Kesmoor, part 1") and linkage.title_places(None) == []
    for a, b in (("tarn", "trn"), ("tarn", "taarn"), ("tarn", "tran"), ("tarn", "tern")):
        assert set(linkage.spelling_keys(a + "abc")) & set(linkage.spelling_keys(b + "abc"))


def test_linkage_finds_planted_pairs(spark):
    rng = random.Random(5)
    syllables = ["bra", "vu", "kle", "sno", "dri", "mo", "gla", "ty", "fe", "zu", "pe", "ra"]
    entities, values, raw, truth = [], [], [], set()
    for i in range(300):
        stem = "".join(rng.choice(syllables) for _ in range(4)).capitalize()
        town, region = f"{stem[:4]}{i}ton".replace("0", "o"), rng.choice(["Estmark", "Norvald", "Vantia"])
        area, depth = round(rng.uniform(100, 1e6), 1), round(rng.uniform(1, 30), 2)
        entities.append((i, f"d{i}", f"e{i}", f"{stem} Lake", None, f"{town}, {region}, Caldor" if i % 5 else None, "lake"))
        values += [(f"e{i}", "surface_area", area), (f"e{i}", "max_depth", depth)]
        if i % 2 == 0:
            swapped = stem[:3] + stem[4] + stem[3] + stem[5:] if i % 4 == 0 else stem
            name = None if i % 10 == 6 else f"{swapped} L."
            raw += [(i, f"Water survey of {region}, part 1", name, f"{town}, Caldor", "lake", a, v * rng.uniform(0.99, 1.01)) for a, v in (("surface_area", area), ("max_depth", depth))]
            truth.add((f"e{i}", i))
        else:
            raw.append((i, "Water survey of Kesmoor, part 1", f"{stem} Lake", "Elsewhereton, Caldor", "lake", "surface_area", area * 9))
    e = spark.createDataFrame([*entities, (1000, "d", "e1000", "", "", "", None), (1001, None, None, None, None, None, None), (0, "d0", "e0", *entities[0][3:])], "row_id bigint, document_id string, entity_id string, name string, identifiers string, location string, ecosystem string").selectExpr("*", "1 as site_no", "2 as confidence")
    v = spark.createDataFrame(values, "entity_id string, attribute_std string, value_common double")
    r = spark.createDataFrame([*raw, (None, None, None, None, None, None, None)], "site_no bigint, title string, name string, location string, ecosystem string, attribute string, value double")
    got = {(x.entity_id, x.site_no) for x in linkage.link(e, v, r).collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95
    assert linkage.link(e.where("false"), v.where("false"), r.where("false")).count() == 0


def test_other_items_never_change_a_leak(spark):
    rng = random.Random(11)
    items = [(i, passage(rng)) for i in range(6)]
    docs = spark.createDataFrame([(i, "Some words before. " + t[: int(len(t) * 0.8)] + " and after.") for i, t in items], "doc_id bigint, text string")
    alone = {}
    for i, t in items:
        for r in leaks.find_leaks(docs, spark.createDataFrame([(i, t)], "item_id bigint, text string")).collect():
            alone[r.doc_id, r.item_id] = (r.item_start, r.share)
    for chars in (10**9, 0):
        got = leaks.find_leaks(docs, spark.createDataFrame([*items, (99, "lake pond may according sampled")], "item_id bigint, text string"), settings=leaks.Settings(broadcast_chars=chars)).collect()
        assert {(r.doc_id, r.item_id): (r.item_start, r.share) for r in got} == alone and len(alone) == 6


def test_the_bound_keeps_every_run_that_extension_finds():
    rng = random.Random(12)
    s = leaks.Settings()
    for _ in range(60):
        item = leaks.Item(1, passage(rng), s)
        words = passage(rng).split() + item_text(item, rng) + passage(rng).split()
        doc = leaks.normalised(" ".join(words))
        h, at = leaks.fingerprints(doc, s.k, s.w)
        hits = [(n, d) for n, x in enumerate(item.hashes.tolist()) for y, d in zip(h.tolist(), at.tolist()) if x == y]
        if not hits:
            continue
        number, dpos = (leaks.np.array(x) for x in zip(*hits))
        whole = item.leak(doc, number, dpos)
        index = leaks.Index([item])
        got = index.leaks(doc, h, at)
        if whole and len({d - item.at[n] for n, d in hits}) == 1:  # on one diagonal the bound may not lose anything
            assert got and got[0][2] == whole[1]


def item_text(item, rng):
    """A stretch of the item, of any length."""
    a = rng.randint(0, max(0, len(item.text) - 20))
    return [item.text[a : a + rng.randint(15, len(item.text))]]


def test_running_lines_are_alike_and_page_numbers_run_on(spark):
    keys = spark.createDataFrame([("snifusuleyetal", 9), ("snifusuleyetel", 1), ("snlfusuleyetal", 1), ("favusoeksenetal", 5), ("short", 3), ("shart", 1)], "key string, n bigint")
    got = {r.key: r.like for r in scans.alike_keys(keys).collect()}
    assert got["snifusuleyetel"] == got["snlfusuleyetal"] == got["snifusuleyetal"] == "snifusuleyetal"
    assert got["favusoeksenetal"] == "favusoeksenetal" and got["shart"] == "shart"
    # printed numbers are 100 ahead of the pages; a number alone on a line that fits no sequence is text
    pages = [(i, "W1", float(i), f"Text of the page\n\nmore text here\n{100 + i}") for i in range(4)] + [(9, "W2", 5.0, "text\n\n1998\n\nmore text")]
    df = spark.createDataFrame(pages, "context_id bigint, document_id string, page_number double, context string")
    assert {r.document_id: r.offset for r in scans._offsets(df).collect()} == {"W1": 100}
    kinds = {(r.context_id, r.line_no): r.kind for r in scans._lines(df.withColumn("page_number", df.page_number.cast("int"))).collect()}
    assert all(kinds[i, 4] == "page_no" for i in range(4)) and kinds[9, 3] == "text"


def test_keys_are_compared_with_all_more_frequent_ones_of_two_equal_parts(spark):
    # the most frequent key of the two parts is too far, the next one near
    rows = [("aaaaabbbbbvwxyz", 9), ("aaaaabbbbbccccc", 5), ("aaaaabbbbbccccd", 1)]
    got = {r.key: r.like for r in scans.alike_keys(spark.createDataFrame(rows, "key string, n bigint")).collect()}
    assert got == {"aaaaabbbbbvwxyz": "aaaaabbbbbvwxyz", "aaaaabbbbbccccc": "aaaaabbbbbccccc", "aaaaabbbbbccccd": "aaaaabbbbbccccc"}

    def signs(k):
        t = -(-len(k) // 3)
        return {(1, k[: 2 * t]), (2, k[:t], k[2 * t :]), (3, k[t : 2 * t], k[2 * t :]), (4, k[:t], k[len(k) - t :])}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    rng = random.Random(3)
    keys = {"".join(rng.choice(["abcde", "fghij"]) for _ in range(2)) + "".join(rng.choice("klm") for _ in range(rng.randint(3, 6))): rng.randint(1, 4) for _ in range(250)}
    want = {}
    for k, n in keys.items():
        fit = [(m, o) for o, m in keys.items() if m > n and signs(o) & signs(k) and distance(k, o) <= max(1, int(len(k) * 0.2))]
        want[k] = max(fit)[1] if fit else k
    df = spark.createDataFrame(list(keys.items()), "key string, n bigint")
    for hot in (4, 10**9):
        assert {r.key: r.like for r in scans.alike_keys(df, hot=hot).collect()} == want


def test_very_long_words_and_lines_are_read(spark):
    word = "sedimentation" * 10
    broken = word.replace("m", "rn", 1)
    lines = ["\n".join([f"The {word} was long and {'very ' * 60}long."] * 4)] * 5 + [f"The {broken} was seen."]
    df = spark.createDataFrame([(i, f"W{i}", 1, t) for i, t in enumerate(lines)], "context_id bigint, document_id string, page_number int, context string")
    found = {(r.context_id, r.kind, r.word) for r in scans.repair(df)[0].collect()}
    assert (5, "misread", word) in found
