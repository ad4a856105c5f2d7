"""DuckDB SQL for the same results, put together from named subqueries; written apart from the Spark plans."""

from __future__ import annotations

import re

from langloom import constants as K
from langloom.plans.queries import NAMES, SPLIT_DOCS, SPLIT_EVAL
from langloom.sources.registry import LANGUAGES

M = 4294967295


def push(h: str, cp: str) -> str:
    for shift in (0, 8, 16):
        h = f"((xor({h}, (({cp} >> {shift}) & 255)) * 16777619) & {M})"
    return f"(({h} * 16777619) & {M})"


def points(*cps: str) -> str:
    h = "2166136261::BIGINT"
    for cp in cps:
        h = push(h, cp)
    return h


def word(text: str) -> str:
    return f"list_reduce(list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT), lambda h, x: {push('h', 'x')}, 2166136261::BIGINT)"


def logprob(p: str) -> str:
    return f"greatest(least(round(ln(greatest({p}, 1.1754943508222875e-38::FLOAT)::DOUBLE)::FLOAT::DOUBLE * 4096), 32767), -32768)::BIGINT"


def smoothed(c: str, t: str, bottom: float = 0.5) -> str:
    return f"((({c})::FLOAT + 0.5::FLOAT)::DOUBLE / (({t})::FLOAT + {bottom}::FLOAT)::DOUBLE)::FLOAT"


def probability(p: str) -> str:
    return f"round((greatest(least({p}, 1::FLOAT), 0::FLOAT) * 65535::FLOAT)::DOUBLE)::BIGINT"


def char_class(c: str) -> str:
    u = f"unicode({c})"
    return f"""CASE WHEN {u} BETWEEN 97 AND 122 THEN 0 WHEN {u} BETWEEN 65 AND 90 THEN 1 WHEN {u} BETWEEN 48 AND 57 THEN 2 WHEN {u} = 32 OR {u} BETWEEN 9 AND 13 THEN 3 WHEN {u} < 128 THEN 4
        WHEN regexp_matches({c}, '^[\\p{{Zs}}]') THEN 3 WHEN regexp_matches({c}, '^\\p{{Ll}}') THEN CASE WHEN {u} BETWEEN 192 AND 591 OR {u} BETWEEN 7680 AND 7935 THEN 5 ELSE 11 END
        WHEN regexp_matches({c}, '^\\p{{Lu}}') THEN 1 WHEN regexp_matches({c}, '^\\p{{N}}') THEN 2 WHEN regexp_matches({c}, '^\\p{{L}}') THEN 11 ELSE 4 END"""


ENDS, TOKEN = "[.!?…。！？\\n]", "[\\p{L}\\p{N}]+"
LIMITS = " ".join(f"WHEN {s} THEN {K.TOP_K[s]}" for s in K.NGRAM_SECTIONS)


def mixed(rows: str) -> str:
    """Adds mh to rows with columns ph, th."""
    return f"""SELECT *, xor(m2, m2 >> 13) AS mh FROM (SELECT *, ((m1::HUGEINT * 2246822507) & {M}::HUGEINT)::BIGINT AS m2 FROM (SELECT *, xor(m0, m0 >> 15) AS m1 FROM (
        SELECT *, xor((xor((ph * 16777619) & {M}, 2654435769) * 16777619) & {M}, th) AS m0 FROM ({rows}))))"""


def pairs_of(sents: str, by: str) -> str:
    return f"SELECT {by}, s[1] AS tok, s[2] AS prev, count(*) AS n FROM (SELECT {by}, unnest(list_zip(tk, list_prepend(NULL, tk))) AS s FROM {sents}) WHERE s[1] IS NOT NULL GROUP BY ALL"


def sents_of(rows: str, by: str) -> str:
    return f"SELECT * FROM (SELECT {by}, regexp_extract_all(s, '{TOKEN}') AS tk FROM (SELECT {by}, unnest(regexp_split_to_array(f, '{ENDS}')) AS s FROM {rows})) WHERE len(tk) > 0"


def entry(section: int, key: str, n: str, rows: str, where: str = "true", sub: str = "0") -> str:
    return f"SELECT lang, {section} AS section, ({key})::BIGINT AS key, ({sub})::BIGINT AS sub, sum({n})::BIGINT AS cnt FROM {rows} WHERE {where} GROUP BY ALL"


WITH = {
    "train": "SELECT doc_id, lang, text FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL AND text <> ''",
    "target": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "split": f"""SELECT doc_id, lang, text, i AS position, CASE WHEN i % {SPLIT_DOCS // SPLIT_EVAL} = 0 AND i // {SPLIT_DOCS // SPLIT_EVAL} <= {SPLIT_EVAL} THEN 'eval' ELSE 'train' END AS split FROM (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL AND text <> '')
        WHERE (i - 1) - least((i - 1) // {SPLIT_DOCS // SPLIT_EVAL}, {SPLIT_EVAL}) < {SPLIT_DOCS}""",
    "docs": f"SELECT doc_id, lang, substring(lower(text), 1, {K.TRAIN_CHARS}) AS f, substring(text, 1, {K.TRAIN_CHARS}) AS o FROM train",
    "win": """SELECT lang, s[1] AS c1, s[2] AS c2, s[3] AS c3, s[4] AS o1, s[5] AS o2, count(*) AS n FROM (
        SELECT lang, unnest(list_zip(c, c[2:], c[3:], p, p[2:])) AS s FROM (SELECT lang, string_split(f, '') AS c, string_split(o, '') AS p FROM docs)) GROUP BY ALL""",
    "cps": "SELECT lang, unicode(c1)::BIGINT AS a, unicode(c2)::BIGINT AS b, unicode(c3)::BIGINT AS c, c2, c3, sum(n) AS n FROM win WHERE c1 IS NOT NULL GROUP BY ALL",
    "sents": sents_of("docs", "lang, doc_id"),
    "pairs": pairs_of("sents", "lang"),
    "words": f"SELECT tok, {word('tok')} AS h, length(tok) AS len, {word('substring(tok, 1, 4)')} AS pre, {word('right(substring(tok, 1, 8), 4)')} AS suf, unicode(tok[1])::BIGINT AS fc, unicode(right(substring(tok, 1, 8), 1))::BIGINT AS lc FROM (SELECT DISTINCT tok FROM pairs)",
    "toks": "SELECT lang, tok, h, len, pre, suf, fc, lc, sum(n)::BIGINT AS n FROM pairs JOIN words USING (tok) GROUP BY ALL",
    "twos": mixed("SELECT p.lang, p.n, a.h AS ph, b.h AS th FROM pairs p JOIN words a ON a.tok = p.prev JOIN words b ON b.tok = p.tok"),
    "inner_chars": "SELECT lang, n, unicode(unnest(string_split(substring(substring(tok, 1, 8), 2, length(substring(tok, 1, 8)) - 2), '')))::BIGINT AS cp FROM toks WHERE len >= 3",
    "counts": " UNION ALL ".join(
        (
            entry(K.CHAR_UNIGRAM, "a", "n", "cps"), entry(K.CHAR_BIGRAM, "h", "n", f"(SELECT lang, n, {points('a', 'b')} AS h FROM cps WHERE c2 IS NOT NULL)"),
            entry(K.CHAR_TRIGRAM, "h", "n", f"(SELECT lang, n, {points('a', 'b', 'c')} AS h FROM cps WHERE c3 IS NOT NULL)"), entry(K.TOKEN_UNIGRAM, "h", "n", "toks"), entry(K.TOKEN_BIGRAM, "mh", "n", "twos"),
            entry(K.WORD_LENGTH, "least(len, 31)", "n", "toks"), entry(K.SENTENCE_LENGTH, "least(len(tk), 63)", "1", "sents"), entry(K.PREFIX, "pre", "n", "toks", "len >= 2"), entry(K.SUFFIX, "suf", "n", "toks", "len >= 2"),
            f"SELECT lang, section, key, sub, sum(cnt)::BIGINT AS cnt FROM ({entry(K.CHAR_POSITION, 'fc', 'n', 'toks', 'len >= 2')} UNION ALL {entry(K.CHAR_POSITION, 'lc', 'n', 'toks', 'len >= 2', '2')} UNION ALL {entry(K.CHAR_POSITION, 'cp', 'n', 'inner_chars', 'true', '1')}) GROUP BY ALL",
            entry(K.CLASS_PAIR, char_class("o1"), "n", "win", "o2 IS NOT NULL", char_class("o2")),
        )
    ),
    "stats": "SELECT d.lang, count(*) AS docs, sum(length(f))::BIGINT AS chars_total, coalesce(any_value(t), 0)::BIGINT AS tokens_total FROM docs d LEFT JOIN (SELECT lang, sum(len(tk)) AS t FROM sents GROUP BY lang) USING (lang) GROUP BY d.lang",
    "tot": "SELECT lang, section, greatest(sum(cnt), 1)::BIGINT AS total FROM counts GROUP BY ALL",
    "top": f"SELECT * EXCLUDE (k) FROM (SELECT lang, section, key, cnt, row_number() OVER (PARTITION BY lang, section ORDER BY cnt DESC, key) AS k FROM counts WHERE section IN {K.NGRAM_SECTIONS}) WHERE k <= CASE section {LIMITS} END",
    "ngrams": f"SELECT lang, section, key, cnt, {logprob(smoothed('cnt', 'total'))} AS q FROM top JOIN tot USING (lang, section)",
    "idfs": f"""SELECT key, df, round(greatest(least(ln(((nl::FLOAT - df::FLOAT + 0.5::FLOAT)::DOUBLE / (df::FLOAT + 0.5::FLOAT)::DOUBLE)::FLOAT::DOUBLE + 1)::FLOAT, 63::FLOAT), 0::FLOAT)::DOUBLE * 1024)::BIGINT AS idf_q
        FROM (SELECT key, count(DISTINCT lang) AS df FROM counts WHERE section = {K.TOKEN_UNIGRAM} GROUP BY key), (SELECT count(*) AS nl FROM stats)""",
    "idf": f"SELECT lang, key, coalesce(idf_q, 0) AS idf_q FROM top LEFT JOIN idfs USING (key) WHERE section = {K.TOKEN_UNIGRAM}",
    "hists": f"""SELECT lang, section, bin, {probability("(coalesce(cnt, 0)::FLOAT::DOUBLE / coalesce(total, 1)::FLOAT::DOUBLE)::FLOAT")} AS q FROM (SELECT lang, section, unnest(range(size)) AS bin FROM stats, (VALUES (5, 32), (6, 64)) v(section, size))
        LEFT JOIN (SELECT lang, section, key AS bin, cnt FROM counts) USING (lang, section, bin) LEFT JOIN tot USING (lang, section)""",
    "charpos": f"""SELECT lang, row_index, cp, slot, {logprob(smoothed('coalesce(cnt, 0)', 'ci', 1.5))} AS q FROM (SELECT lang, key AS cp, cnt AS ci, row_number() OVER (PARTITION BY lang ORDER BY key) - 1 AS row_index, unnest([0, 1, 2]) AS slot FROM (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, key) AS k FROM counts WHERE section = 0) WHERE k <= {K.CHAR_POSITION_CHARS})
        LEFT JOIN (SELECT lang, key AS cp, sub AS slot, cnt FROM counts WHERE section = {K.CHAR_POSITION}) USING (lang, cp, slot)""",
    "classes": f"""SELECT lang, a, b, {probability(smoothed('coalesce(cnt, 0)', 'greatest(sum(coalesce(cnt, 0)) OVER (PARTITION BY lang, a), 1)'))} AS q FROM (SELECT lang, a, unnest(range(12)) AS b FROM (SELECT lang, unnest(range(12)) AS a FROM stats))
        LEFT JOIN (SELECT lang, key AS a, sub AS b, cnt FROM counts WHERE section = {K.CLASS_PAIR}) USING (lang, a, b)""",
    "header": f"""SELECT row_number() OVER (ORDER BY lang) - 1 AS lang_index, lang, docs, chars_total, tokens_total, round((tokens_total::FLOAT::DOUBLE / docs::FLOAT::DOUBLE)::FLOAT::DOUBLE, 3) AS avg_doc_len, {logprob(smoothed('0', 'coalesce(total, 1)'))} AS oov
        FROM stats LEFT JOIN (SELECT lang, total FROM tot WHERE section = {K.CHAR_TRIGRAM}) USING (lang)""",
    # scoring
    "folded": f"SELECT doc_id, lower(text) AS f, substring(lower(text), 1, {K.SCORE_CHARS}) AS cut FROM target WHERE text <> ''",
    "dwin": "SELECT doc_id, s[1] AS c1, coalesce(s[2], '') AS c2, coalesce(s[3], '') AS c3, count(*) AS n FROM (SELECT doc_id, unnest(list_zip(c, c[2:], c[3:])) AS s FROM (SELECT doc_id, string_split(cut, '') AS c FROM folded)) GROUP BY ALL",
    "dkeys": f"""SELECT c1, c2, c3, a, CASE WHEN c2 <> '' THEN {points('a', 'b')} END AS h2, CASE WHEN c3 <> '' THEN {points('a', 'b', 'c')} END AS h3, {char_class('c1')} AS ka, CASE WHEN c2 <> '' THEN {char_class('c2')} END AS kb
        FROM (SELECT *, unicode(c1)::BIGINT AS a, unicode(c2)::BIGINT AS b, unicode(c3)::BIGINT AS c FROM (SELECT DISTINCT c1, c2, c3 FROM dwin))""",
    "kscores": """SELECT k.c1, k.c2, k.c3, l.lang_index, coalesce(u.q, oov) AS uni, CASE WHEN h2 IS NULL THEN 0 ELSE coalesce(b.q, oov) END AS bi, CASE WHEN h3 IS NULL THEN 0 ELSE coalesce(t.q, oov) END AS tri, coalesce(c.q, 0) AS cls
        FROM dkeys k CROSS JOIN header l LEFT JOIN ngrams u ON u.lang = l.lang AND u.section = 0 AND u.key = k.a LEFT JOIN ngrams b ON b.lang = l.lang AND b.section = 1 AND b.key = k.h2
        LEFT JOIN ngrams t ON t.lang = l.lang AND t.section = 2 AND t.key = k.h3 LEFT JOIN classes c ON c.lang = l.lang AND c.a = k.ka AND c.b = k.kb""",
    "cterms": "SELECT doc_id, lang_index, sum(n)::BIGINT AS n, sum(n * uni)::BIGINT AS uni, sum(n * bi)::BIGINT AS bi, sum(n * tri)::BIGINT AS tri, sum(n * cls)::BIGINT AS cls FROM dwin JOIN kscores USING (c1, c2, c3) GROUP BY ALL",
    "dsents": sents_of("folded", "doc_id"),
    "dpairs": pairs_of("dsents", "doc_id"),
    "dwords": f"SELECT tok, {word('tok')} AS h, length(tok) AS len, {word('substring(tok, 1, 4)')} AS pre, {word('right(substring(tok, 1, 8), 4)')} AS suf, unicode(tok[1])::BIGINT AS fc, unicode(right(substring(tok, 1, 8), 1))::BIGINT AS lc FROM (SELECT DISTINCT tok FROM dpairs)",
    "places": f"SELECT lang, key, slot, q FROM (SELECT lang, key, row_number() OVER (PARTITION BY lang ORDER BY key) - 1 AS row_index FROM ngrams WHERE section = 0) JOIN charpos USING (lang, row_index)",
    "wscores": f"""SELECT w.tok, l.lang_index, coalesce(u.q, oov) * (4096 + coalesce(i.idf_q, 0)) AS tok_s, CASE WHEN len >= 2 THEN coalesce(p.q, oov) + coalesce(s.q, oov) ELSE 0 END AS affix, CASE WHEN len >= 2 THEN coalesce(x.q, oov) + coalesce(y.q, oov) ELSE 0 END AS pos, h.q AS wl, CASE WHEN len >= 2 THEN 2 ELSE 0 END AS np
        FROM dwords w CROSS JOIN header l LEFT JOIN ngrams u ON u.lang = l.lang AND u.section = {K.TOKEN_UNIGRAM} AND u.key = w.h LEFT JOIN idf i ON i.lang = l.lang AND i.key = w.h
        LEFT JOIN ngrams p ON p.lang = l.lang AND p.section = {K.PREFIX} AND p.key = w.pre LEFT JOIN ngrams s ON s.lang = l.lang AND s.section = {K.SUFFIX} AND s.key = w.suf
        LEFT JOIN places x ON x.lang = l.lang AND x.slot = 0 AND x.key = w.fc LEFT JOIN places y ON y.lang = l.lang AND y.slot = 2 AND y.key = w.lc LEFT JOIN hists h ON h.lang = l.lang AND h.section = 5 AND h.bin = least(w.len, 31)""",
    "wterms": "SELECT doc_id, lang_index, sum(n)::BIGINT AS n_tok, sum(n * np)::BIGINT AS n_pos, sum(n * tok_s)::BIGINT AS tok, sum(n * affix)::BIGINT AS affix, sum(n * pos)::BIGINT AS pos, sum(n * wl)::BIGINT AS wl FROM dpairs JOIN wscores USING (tok) GROUP BY ALL",
    "dtwos": mixed("SELECT p.doc_id, p.n, a.h AS ph, b.h AS th FROM dpairs p JOIN dwords a ON a.tok = p.prev JOIN dwords b ON b.tok = p.tok"),
    "bterms": f"SELECT d.doc_id, l.lang_index, sum(d.n)::BIGINT AS n_tokbi, sum(d.n * coalesce(g.q, l.oov))::BIGINT AS tokbi FROM dtwos d CROSS JOIN header l LEFT JOIN ngrams g ON g.lang = l.lang AND g.section = {K.TOKEN_BIGRAM} AND g.key = d.mh GROUP BY ALL",
    "sterms": "SELECT doc_id, lang_index, count(*) AS n_sent, sum(q)::BIGINT AS sl FROM dsents CROSS JOIN header l JOIN hists h ON h.lang = l.lang AND h.section = 6 AND h.bin = least(len(tk), 63) GROUP BY ALL",
    "terms": """SELECT d.doc_id, l.lang_index, coalesce(n, 0) AS n, coalesce(n_tok, 0) AS n_tok, coalesce(n_tokbi, 0) AS n_tokbi, coalesce(n_pos, 0) AS n_pos, coalesce(n_sent, 0) AS n_sent, coalesce(tri, 0) AS tri, coalesce(bi, 0) AS bi, coalesce(uni, 0) AS uni,
        coalesce(tok, 0) AS tok, coalesce(affix, 0) AS affix, coalesce(tokbi, 0) AS tokbi, coalesce(pos, 0) AS pos, coalesce(cls, 0) AS cls, coalesce(wl, 0) AS wl, coalesce(sl, 0) AS sl
        FROM target d CROSS JOIN header l LEFT JOIN cterms USING (doc_id, lang_index) LEFT JOIN wterms USING (doc_id, lang_index) LEFT JOIN bterms USING (doc_id, lang_index) LEFT JOIN sterms USING (doc_id, lang_index)""",
    "scores": """SELECT doc_id, lang_index, lang, (CASE WHEN n = 0 THEN '-infinity'::DOUBLE ELSE
        (CASE WHEN n <= 2 THEN 0.0::DOUBLE ELSE tri / (4096.0::DOUBLE * (n - 2)) END) * (CASE WHEN n < 150 THEN 0.55::DOUBLE ELSE 0.45::DOUBLE END) + (CASE WHEN n <= 1 THEN 0.0::DOUBLE ELSE bi / (4096.0::DOUBLE * (n - 1)) END) * (CASE WHEN n < 150 THEN 0.30::DOUBLE ELSE 0.25::DOUBLE END)
        + uni / (4096.0::DOUBLE * n) * 0.05::DOUBLE + (tok / 4096.0::DOUBLE + 0.2::DOUBLE * affix) / (4096.0::DOUBLE * greatest(n_tok, 1)) * (CASE WHEN n < 150 THEN 0.05::DOUBLE ELSE 0.15::DOUBLE END)
        + (CASE WHEN n_tokbi = 0 THEN 0.0::DOUBLE ELSE tokbi / (4096.0::DOUBLE * n_tokbi) END) * 0.05::DOUBLE + (CASE WHEN n_pos = 0 THEN 0.0::DOUBLE ELSE pos / (4096.0::DOUBLE * n_pos) END) * 0.03::DOUBLE
        + (CASE WHEN n <= 1 THEN 0.0::DOUBLE ELSE cls / (4096.0::DOUBLE * (n - 1)) END) * 0.02::DOUBLE
        + (ln(greatest(CASE WHEN n_tok = 0 THEN 0.0::DOUBLE ELSE wl / (65535.0::DOUBLE * n_tok) END, 1e-6::DOUBLE)) + ln(greatest(CASE WHEN n_sent = 0 THEN 0.0::DOUBLE ELSE sl / (65535.0::DOUBLE * n_sent) END, 1e-6::DOUBLE))) * 0.05::DOUBLE END)::FLOAT AS score
        FROM terms JOIN header USING (lang_index)""",
    "soft": "SELECT *, exp(greatest(least((score - max(score) OVER (PARTITION BY doc_id))::DOUBLE / 0.15::DOUBLE, 0.0::DOUBLE), -20.0::DOUBLE)) AS e FROM scores",
    "ranked": "SELECT doc_id, lang_index, lang, score, CASE WHEN max(score) OVER (PARTITION BY doc_id) = '-infinity'::FLOAT THEN 0.0::FLOAT ELSE (e / sum(e) OVER (PARTITION BY doc_id))::FLOAT END AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang_index) AS rank FROM soft",
    "judged": "SELECT d.doc_id AS case_id, d.lang AS want, r.lang AS got, r.confidence, d.text FROM documents d JOIN ranked r ON r.doc_id = d.doc_id AND r.rank = 1 WHERE d.text IS NOT NULL AND d.lang IS NOT NULL",
}


def sql(final: str, **changed: str) -> str:
    """``final`` with the subqueries that it needs, in order; ``changed`` replaces some."""
    parts = WITH | changed
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+\(*([a-z_]+)\b", text):
            if name in parts and name not in order:
                need(parts[name])
                order.append(name)

    need(final)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({parts[n]})" for n in order) + f" {final}" if order else final


#: A model of the split's training part, scoring other rows.
BY_SPLIT = {"train": "SELECT doc_id, lang, text FROM split WHERE split = 'train'"}
SNIPPET = "replace(substring(text, 1, 80) || CASE WHEN length(text) > 80 THEN '…' ELSE '' END, chr(10), ' ')"
R4 = lambda c: f"round({c}::DOUBLE, 4) AS {c}"


def _counts_sql(section: int) -> str:
    cols = {K.WORD_LENGTH: "key AS bin", K.SENTENCE_LENGTH: "key AS bin", K.CHAR_POSITION: "key AS cp, sub AS slot", K.CLASS_PAIR: "key AS a, sub AS b"}.get(section, "key")
    return sql(f"SELECT lang, {cols}, cnt FROM counts WHERE section = {section}")


def _model_sql(section: int) -> str:
    if section in (K.WORD_LENGTH, K.SENTENCE_LENGTH):
        return sql(f"SELECT lang, bin::BIGINT AS bin, q FROM hists WHERE section = {section}")
    if section == K.CHAR_POSITION:
        return sql("SELECT lang, row_index::BIGINT AS row_index, cp, slot::BIGINT AS slot, q FROM charpos")
    if section == K.CLASS_PAIR:
        return sql("SELECT lang, a::BIGINT AS a, b::BIGINT AS b, q FROM classes")
    if section == K.TOKEN_IDF:
        return sql("SELECT lang, key, idf_q FROM idf")
    return sql(f"SELECT lang, key, cnt, q FROM ngrams WHERE section = {section}")


LONG_FORM = f"""SELECT lang, section::BIGINT AS section, key::BIGINT AS key, 0::BIGINT AS sub, q::BIGINT AS q FROM ngrams UNION ALL SELECT lang, {K.TOKEN_IDF}::BIGINT, key::BIGINT, 0::BIGINT, idf_q::BIGINT FROM idf
    UNION ALL SELECT lang, section::BIGINT, bin::BIGINT, 0::BIGINT, q::BIGINT FROM hists UNION ALL SELECT lang, {K.CHAR_POSITION}::BIGINT, row_index::BIGINT, slot::BIGINT, q::BIGINT FROM charpos
    UNION ALL SELECT lang, {K.CLASS_PAIR}::BIGINT, a::BIGINT, b::BIGINT, q::BIGINT FROM classes"""

ORACLE_SQL: dict[str, str] = {
    "corpus_stats": sql("SELECT lang, docs, chars_total, tokens_total FROM stats"),
    "token_df": sql("SELECT lang, h AS key, count(DISTINCT doc_id) AS df FROM (SELECT lang, doc_id, unnest(tk) AS tok FROM sents) JOIN words USING (tok) GROUP BY ALL"),
    "section_totals": sql("SELECT lang, section::BIGINT AS section, total FROM tot"),
    "merge_counts": sql("SELECT lang, section::BIGINT AS section, key, sub, cnt FROM counts"),
    "token_idf": sql("SELECT key, df, idf_q FROM idfs"),
    "model_header": sql(f"SELECT lang_index, lang, CASE WHEN docs < {K.MAX_DOCS // 2} THEN 1 ELSE 0 END::BIGINT AS flags, docs, chars_total, tokens_total, avg_doc_len, oov AS oov_logprob_q FROM header"),
    "lookup_oov": sql(
        f"""SELECT k.lang, l.lang AS model_lang, count(*) AS keys, sum(CASE WHEN coalesce(g.q, oov) = oov THEN 1 ELSE 0 END)::BIGINT AS at_oov, sum(coalesce(g.q, oov))::BIGINT AS sum_q FROM counts k CROSS JOIN header l
        LEFT JOIN ngrams g ON g.lang = l.lang AND g.section = k.section AND g.key = k.key WHERE k.section = {K.CHAR_TRIGRAM} GROUP BY ALL"""
    ),
    "doc_terms": sql("SELECT * FROM terms"),
    "score_all": sql(f"SELECT doc_id, lang_index, {R4('score')} FROM scores"),
    "classify": sql(f"SELECT doc_id, lang, rank, {R4('score')}, {R4('confidence')} FROM ranked"),
    "classify_top": sql(f"SELECT doc_id, lang, {R4('confidence')} FROM ranked WHERE rank = 1"),
    "classify_conversations": sql(f"SELECT doc_id, lang, {R4('score')} FROM ranked WHERE rank = 1", target="SELECT conv_id * 1000000 + turn AS doc_id, coalesce(text, '') AS text FROM conversations"),
    "train_eval_split": sql("SELECT doc_id, lang, position, split FROM split"),
    "doc_cap": f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL AND text <> '') WHERE i <= {SPLIT_DOCS}",
    "eval_accuracy": sql(
        """SELECT any_value(lang_index) FILTER (WHERE grouping_id = 0) AS lang_index, CASE WHEN grouping_id = 0 THEN lang ELSE 'TOTAL' END AS lang, sum(ok)::BIGINT AS ok, sum(total)::BIGINT AS total FROM (
        SELECT h.lang_index, h.lang, count(*) FILTER (WHERE r.lang_index = h.lang_index) AS ok, count(r.doc_id) AS total, unnest([0, 1]) AS grouping_id FROM header h LEFT JOIN split s ON s.lang = h.lang AND s.split = 'eval' LEFT JOIN ranked r ON r.doc_id = s.doc_id AND r.rank = 1 GROUP BY h.lang_index, h.lang
        ) GROUP BY grouping_id, CASE WHEN grouping_id = 0 THEN lang ELSE 'TOTAL' END""",
        **BY_SPLIT, target="SELECT doc_id, text FROM split WHERE split = 'eval'",
    ),
    "benchmark_report": sql("SELECT want, sum(CASE WHEN got = want THEN 1 ELSE 0 END)::BIGINT AS ok, count(*) AS total, round(avg(confidence::DOUBLE), 4) AS avg_confidence FROM judged GROUP BY ROLLUP (want)", **BY_SPLIT),
    "benchmark_misses": sql(f"SELECT case_id, want, got, {SNIPPET} AS snippet FROM judged WHERE got <> want", **BY_SPLIT),
    "source_misses": sql(f"SELECT case_id, want, got, {SNIPPET} AS snippet FROM judged WHERE got <> want", **BY_SPLIT, judged=WITH["judged"].replace("d.lang", "d.source")),
    "line_files": "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE NOT regexp_full_match(line, '[\\s\\v]*') GROUP BY line",
    "json_file_cases": f"SELECT length(text) AS chars, lang AS want, {SNIPPET} AS snippet FROM documents WHERE doc_id % 4 <> 2 AND text IS NOT NULL AND lang IS NOT NULL",
    "bundle_roundtrip": sql(LONG_FORM),
    "text_scan_filter": f"SELECT doc_id, length(text) AS chars, {SNIPPET} AS snippet FROM documents WHERE text IS NOT NULL AND text <> ''",
    "lang_registry": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{c}', '{r}', '{','.join(p)}')" for i, (c, r, p) in enumerate(LANGUAGES)) + ") v(lang_index, code, repo, prefixes)",
    "json_cases": "SELECT doc_id AS case_id, length(text) AS chars, lang AS want FROM documents WHERE doc_id % 4 <> 2 AND text IS NOT NULL AND lang IS NOT NULL",
    "char_classes": f"SELECT unicode(c)::BIGINT AS cp, ({char_class('c')})::BIGINT AS class, c IN ('.', '!', '?', '…', '。', '！', '？', chr(10)) AS sentence_end, count(*) AS cnt FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text IS NOT NULL) GROUP BY c",
    "model_roundtrip": sql(LONG_FORM),
}
ORACLE_SQL["doc_terms_arrow"], ORACLE_SQL["classify_columns"] = ORACLE_SQL["doc_terms"], ORACLE_SQL["classify"]
ORACLE_SQL |= {name: _counts_sql(s) for s, (name, _) in NAMES.items() if name}
ORACLE_SQL |= {name: _model_sql(s) for s, (_, name) in NAMES.items()}
