"""The SQL counterparts of catalog.py, for an engine with RE2 patterns and list lambdas.

Look-behind is not to be had there: sentence ends are marked by chr(1) and split at the mark.
"""

from __future__ import annotations

import re
import unicodedata

from lexloom.functions import detect, metrics
from lexloom.functions import normalize as N
from lexloom.functions import predicates as P
from lexloom.functions import text as T
from lexloom.operators import chunking, models, structure


def lit(s: str) -> str:
    """A literal; control characters are spelled by chr()."""
    out, plain = [], ""
    for c in s:
        if c < " ":
            if plain:
                out.append("'" + plain.replace("'", "''") + "'")
            out.append(f"chr({ord(c)})")
            plain = ""
        else:
            plain += c
    if plain or not out:
        out.append("'" + plain.replace("'", "''") + "'")
    return out[0] if len(out) == 1 else "(" + " || ".join(out) + ")"


def pat(pattern: str) -> str:
    return "'" + T.rx(pattern).replace("'", "''").replace("(?U)", "").replace("(?iu)", "(?i)") + "'"


def rep(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {pat(pattern)}, {lit(to)}, 'g')"


def chain(x: str, steps) -> str:
    for pattern, to in steps:
        x = rep(x, pattern, to)
    return x


def strip(x: str) -> str:
    return rep(x, "^{s}+|{s}+$", "")


def tok(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {pat('{s}+')}), lambda z: z <> '')"


def n_tok(x: str) -> str:
    return f"len({tok(x)})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {pat(pattern)})"


def lines(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN [] ELSE string_split_regex({rep(x, '(?:' + T.BREAK + ')\\z', '')}, {pat(T.BREAK)}) END"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, {pat('([.!?]){s}+([A-Z])')}, '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda q: {strip('q')}), lambda q: q <> '')"


def condensed(x: str) -> str:
    return f"array_to_string(({sentences(x)})[1:3], ' ')"


def light(x: str) -> str:
    marked = f"regexp_replace({x}, {pat('([.!?]){s}+')}, '\\1' || chr(1), 'g')"
    parts = f"list_transform(string_split({marked}, chr(1)), lambda q: {strip('q')})"
    return f"array_to_string(list_filter({parts}, lambda q: q <> '' AND length({rep('q', '[^a-zA-Z]', '')})::DOUBLE / length(q) >= 0.2::DOUBLE), ' ')"


def bullets(x: str) -> str:
    bare = f"list_filter(list_transform({lines(x)}, lambda l: {strip(rep(strip('l'), N.BULLET, ''))}), lambda l: l <> '')"
    return f"array_to_string(list_transform({bare}, lambda l: CASE WHEN {has('l', '[.!?]$')} THEN l ELSE l || '.' END), ' ')"


def plain(x: str) -> str:
    return rep(x, T.MIXED, "0")


def heading(x: str) -> str:
    capitals = f"({has(x, r'\p{Lu}')} AND NOT {has(x, r'[\p{Ll}\p{Lt}]')})"
    numbered = has(x, r"^{d}+(?:\.{d}+)*{s}+[A-Z]")
    return f"({capitals} OR {numbered} OR ({n_tok(x)} <= 6 AND ends_with({x}, ':')))"


def paragraphs(lines_sql: str) -> str:
    """Expects lines_sql to name a column of stripped lines."""
    before = f"{lines_sql}[i - 1]"
    opens = f"(i = 1 OR {before} = '' OR {has(before, '[.!?:]$')} OR {heading('l')})"
    piece = f"CASE WHEN l = '' THEN '' ELSE (CASE WHEN {opens} THEN chr(10) || chr(10) ELSE ' ' END) || l END"
    return f"regexp_replace(array_to_string(list_transform({lines_sql}, lambda l, i: {piece}), ''), '^\\n\\n', '')"


def per_paragraph(x: str) -> str:
    return chain(f"array_to_string(list_transform(string_split({x}, chr(10) || chr(10)), lambda p: {light('p')}), chr(10) || chr(10))", N.SQUEEZE)


def docs(*steps: str, final: str) -> str:
    """CTEs over documents; each step is 'name AS (...)'."""
    first = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
    return "WITH " + ", ".join([first, *steps]) + " " + final


def text_md5(x: str, like: str = "text") -> str:
    return docs(f"e AS (SELECT doc_id, {like} AS text FROM d)", f"m AS (SELECT doc_id, {x} AS t FROM e)", final="SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM m")


def of_text(like: str = "text", **cols: str) -> str:
    return docs(f"e AS (SELECT doc_id, {like} AS text FROM d)", final="SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + " FROM e")


def of_lines(**cols: str) -> str:
    rows = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM d)"
    return docs(rows, final="SELECT doc_id, pos, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + " FROM l")


def of_array(x: str, like: str = "text") -> str:
    return docs(
        f"e AS (SELECT doc_id, {like} AS text FROM d)",
        f"a AS (SELECT doc_id, {x} AS xs FROM e)",
        "r AS (SELECT doc_id, unnest(xs) AS t, generate_subscripts(xs, 1) - 1 AS pos FROM a)",
        final="SELECT doc_id, pos, length(t) AS n_chars, md5(t) AS text_md5 FROM r",
    )


NL = "chr(10)"
BOOK = f"""({lit("THE BOOK OF MANY LINES" + chr(10) + "By: Ann Lee" + chr(10) + "Contents" + chr(10))}
  || array_to_string(list_transform(string_split(text, {NL}), lambda x, i: 'Chapter ' || i || ': Heading of it' || {NL} || x), {NL}) || {NL} || repeat(text || {NL}, 6))"""
_ODD = "length(text) % 2 = 1"
PAPER = f"""({lit("A Study of Made Up Words and Lines" + chr(10) + "Ann Lee, 1" + chr(10) + "Bob Ray, 2" + chr(10) + "Department of Text" + chr(10) + "Abstract" + chr(10))} || text
  || {lit(chr(10) + "Introduction" + chr(10) * 2 + "  first words" + chr(10))}
  || CASE WHEN {_ODD} THEN {lit("Methodology" + chr(10) + "how" + chr(10) + "results" + chr(10) + "what" + chr(10) + "RELATED WORK" + chr(10) + "who" + chr(10))} ELSE '' END
  || {lit("Conclusion" + chr(10))} || text || {lit(chr(10) + "abstract" + chr(10))}
  || CASE WHEN {_ODD} THEN {lit("again" + chr(10) + "Discussion" + chr(10) + "why" + chr(10))} ELSE {NL} END || {lit("References" + chr(10) + "[1] x" + chr(10))})"""
OCR = "(text || " + lit("\r\nThe of ce is speci c: 3D v1.5,ok end.Next SIGNI CANT de nition and ef cient.Made with Gamma\r1 inter-\n  national\x07 5 modern clear vv 0\n42\n3.5\n#$%&*\n12 AB X-9 foo") + ")"
NOTED = f"({lit('### Topic one' + chr(10) + '* point:x' + chr(10))} || text || {lit(chr(10) * 5 + '- point.Again' + chr(10) * 3 + '* point:x' + chr(10) + ' 3. Point x' + chr(10) + '### Topic two' + chr(10) + 'End.X' + chr(10))})"
PAGED = f"(array_to_string(list_transform(string_split(text, {NL}), lambda x: x || {lit(chr(10) + 'Page 1 of 2' + chr(10) + 'www.example.org' + chr(10))}), {NL}) || {lit(chr(10) + 'Copyright 2019')})"
ABBREVIATED = "(text || ' Dr. Who met Mrs. Lee, e.g. Ann. See Fig. A and i.e. Then etc. Ok? Yes! No.')"
SECTIONED = f"(replace(text, {NL}, {NL} || '1.2 A ') || {NL} || '2.1 Last. One')"


def nfkd(x: str) -> str:
    """Letters of Latin-1 and Latin Extended-A by their decompositions; others don't occur in the tables."""
    for code in range(0xA0, 0x180):
        c = chr(code)
        if (flat := unicodedata.normalize("NFKD", c)) != c:
            x = f"replace({x}, '{c}', '{flat}')"
    return x


def boilerplate(line: str, canon: str) -> str:
    return f"""(length({canon}) < 4 OR {n_tok(canon)} <= 2 OR {has(canon, "^[0-9]+$")} OR {has(canon, P.BOILERPLATE_WORDS)}
      OR {has(f"lower({line})", P.BOILERPLATE_MARKS)} OR ({n_tok(canon)} <= 10 AND {has(canon, P.BOILERPLATE_YEAR)}) OR {has(line, P.BOILERPLATE_RIGHTS)})"""


def canonical(x: str) -> str:
    return chain(f"lower({x})", N.CANONICAL)


def data_row(x: str) -> str:
    token = f"({has('t', '^{d}+$')} OR {has('t', '^[A-Z]{1,5}$')} OR ({has('t', '^[A-Z0-9-]{2,8}$')} AND {has('t', '{d}')}) OR (length(t) >= 4 AND NOT {has('t', '[aeiouAEIOU]')}))"
    return f"({n_tok(x)} >= 4 AND 2 * len(list_filter({tok(x)}, lambda t: {token})) > {n_tok(x)})"


def symbol_ok(x: str) -> str:
    s = strip(x)
    return f"({s} = '' OR length({rep(s, '[^a-zA-Z0-9]', '')})::DOUBLE / length({s}) >= 0.4::DOUBLE)"


def page_number(x: str) -> str:
    return has(strip(x), r"^{d}+(?:\.{d}+)?$")


def opening(x: str) -> str:
    return chain(x, [*N.NEWLINES, *N.MISSING_SPACES, *N.AFTER_STOPS, *N.DEHYPHENATE])


def ligatures(x: str) -> str:
    for found, whole in N.LIGATURES:
        x = rep(x, rf"(?i)\b{found}\b", whole)
    return x


def cleaned_steps(control: str, like: str) -> list[str]:
    """The cleaner with repeated-line removal at its defaults, where it can remove nothing but a text without a filled line; ends in m(doc_id, t)."""
    return [
        f"a AS (SELECT doc_id, {like} AS text FROM d)",
        f"b AS (SELECT doc_id, {opening('text')} AS text FROM a)",
        f"c AS (SELECT doc_id, {rep(nfkd('text'), control, '')} AS text FROM b)",
        f"e AS (SELECT doc_id, {lines('text')} AS ls FROM c)",
        f"f AS (SELECT doc_id, list_filter(ls, lambda l: {symbol_ok('l')}) AS ls FROM e)",
        f"g AS (SELECT doc_id, CASE WHEN len(list_filter(ls, lambda l: {strip('l')} <> '')) = 0 THEN [] ELSE list_filter(ls, lambda l: NOT {data_row(strip('l'))}) END AS ls FROM f)",
        f"h AS (SELECT doc_id, {ligatures('array_to_string(ls, chr(10))')} AS text FROM g)",
        f"i AS (SELECT doc_id, list_transform(list_filter({lines('text')}, lambda l: NOT {page_number('l')}), lambda l: {strip('l')}) AS ls FROM h)",
        f"j AS (SELECT doc_id, {paragraphs('ls')} AS text FROM i)",
        f"m AS (SELECT doc_id, {per_paragraph('text')} AS t FROM j)",
    ]


def cleaned(control: str) -> str:
    return docs(*cleaned_steps(control, OCR), final="SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM m")


CONTROLS = r"[\x00-\x1f\x7f]"


def tagged(steps: list[str], tag: str, source: str) -> list[str]:
    """Steps with the tag before their names, reading from source in place of d."""
    names = {step.split(" AS ")[0] for step in steps}
    to = lambda m: f"FROM {tag + m[1] if m[1] in names else source if m[1] == 'd' else m[1]}"
    return [tag + re.sub(r"\bFROM (\w+)\b", to, step) for step in steps]


def events(final: str) -> str:
    """The events of the pipeline as all(doc_id, seq, type, ...), by an answering backend. Names of the cleaner's steps get a tag, as the chunker has its own."""
    first = "raw AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
    steps = [
        first,
        *tagged(cleaned_steps(CONTROLS, "text"), "z", "raw"),
        "d AS (SELECT doc_id, t AS text FROM zm WHERE length(t) >= 100)",
        *kinds("d", "d"),
        *chunk_steps(chunking.MIN_TOKENS),
        "bare AS (SELECT doc_id, 0 AS chunk_id, left(text, 8000) AS text FROM d WHERE doc_id NOT IN (SELECT doc_id FROM k))",
        "every AS (SELECT doc_id, chunk_id, text FROM k UNION ALL SELECT doc_id, chunk_id, text FROM bare)",
        f"valid AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS i FROM every WHERE {valid_chunk('text')})",
        """head AS (SELECT dk.doc_id, dk.t AS doc_type, dk.words, (SELECT count(*) FROM valid WHERE valid.doc_id = dk.doc_id) AS total,
          round_even(CASE WHEN dk.t = 'book' THEN b WHEN dk.t = 'paper' THEN p ELSE 1.0::DOUBLE - greatest(b, p) END, 2) AS sure, CASE WHEN length(d.text) > 50000 THEN 1000 ELSE 800 END AS most FROM dk JOIN d ON d.doc_id = dk.doc_id)""",
        """al AS (
          SELECT doc_id, 0 AS seq, 'error' AS type, NULL AS doc_type, NULL::DOUBLE AS confidence, NULL::INT AS words, NULL::INT AS total_chunks, NULL::INT AS max_tokens, NULL::INT AS chunk_id, NULL::BOOLEAN AS is_last, false AS has_summary, NULL::BOOLEAN AS scored FROM zm WHERE length(t) < 100
          UNION ALL SELECT doc_id, 0, 'doc_detected', doc_type, sure, words, NULL, NULL, NULL, NULL, false, NULL FROM head
          UNION ALL SELECT doc_id, 1, 'summary_start', doc_type, sure, words, total, most, NULL, NULL, false, NULL FROM head
          UNION ALL SELECT doc_id, 2 + i, 'chunk_summary', NULL, NULL, NULL, total, NULL, i, i = total - 1, true, NULL FROM valid JOIN head USING (doc_id)
          UNION ALL SELECT doc_id, 2 + total, 'final', doc_type, sure, NULL, total, NULL, NULL, NULL, true, true FROM head)""",
    ]
    return "WITH " + ", ".join(steps) + " " + final


def repeated(threshold: float, most: float) -> str:
    return docs(
        f"e AS (SELECT doc_id, {PAGED} AS text FROM d)",
        f"l AS (SELECT doc_id, pos, line, {canonical('line')} AS k FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform({lines('text')}, lambda l: {strip('l')}), lambda l: l <> '') AS ls FROM e)))",
        f"b AS (SELECT *, max({boilerplate('line', 'k')}::INT) OVER (PARTITION BY doc_id, k) AS bad, count(*) OVER (PARTITION BY doc_id, k) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM l)",
        f"c AS (SELECT *, bad = 1 AND n::DOUBLE / total >= {threshold}::DOUBLE AS gone FROM b)",
        "s AS (SELECT doc_id, max(total) AS total, count(CASE WHEN gone THEN 1 END) AS n_gone, coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '') AS rest FROM c GROUP BY doc_id)",
        f"m AS (SELECT e.doc_id, CASE WHEN s.doc_id IS NULL THEN '' WHEN n_gone = 0 OR 1.0::DOUBLE - (total - n_gone)::DOUBLE / total > {most}::DOUBLE THEN e.text ELSE rest END AS t FROM e LEFT JOIN s USING (doc_id))",
        final="SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM m",
    )


def first_lines(key: str) -> str:
    return docs(
        f"e AS (SELECT doc_id, {NOTED} AS text FROM d)",
        "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM e)",
        f"s AS (SELECT *, {strip('line')} AS s FROM l)",
        f"r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s = '', {key} ORDER BY pos) AS n FROM s)",
        "m AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM r WHERE s = '' OR n = 1 GROUP BY doc_id)",
        final="SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM m",
    )


LOOSE = r"[^\p{L}\p{N}_\x09-\x0D\x1C-\x20\x{85}\p{Z}]"


def abbreviations(x: str) -> str:
    x = f"regexp_replace({x}, '\\be\\.g\\.', 'e' || chr(2) || 'g' || chr(2), 'g')"
    x = f"regexp_replace({x}, '\\bi\\.e\\.', 'i' || chr(2) || 'e' || chr(2), 'g')"
    return f"regexp_replace({x}, {pat(chunking.ABBREVIATION)}, '\\1' || chr(2), 'g')"


def pieces(least: int = 5) -> list[str]:
    return [
        f"c AS (SELECT doc_id, {chain('text', N.CHUNK_CLEAN)} AS text FROM d)",
        f"a AS (SELECT doc_id, {sentences('text')} AS xs FROM c)",
        "r AS (SELECT doc_id, unnest(xs) AS text, generate_subscripts(xs, 1) - 1 AS pos FROM a)",
        f"p AS (SELECT doc_id, pos, text, tokens FROM (SELECT *, {n_tok('text')} AS tokens FROM r) WHERE tokens >= {least})",
    ]


def chunk_steps(least: int) -> list[str]:
    return [
        *pieces(),
        "o AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)",
        f"n AS (SELECT *, sum(CASE WHEN before >= {least} AND tokens >= {least} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk_id FROM o)",
        "k AS (SELECT doc_id, chunk_id, string_agg(text, ' ' ORDER BY pos) AS text, sum(tokens) AS token_count FROM n GROUP BY doc_id, chunk_id)",
    ]


def chunks(least: int) -> str:
    return docs(*chunk_steps(least), final="SELECT doc_id, chunk_id::BIGINT AS chunk_id, token_count::BIGINT AS token_count, md5(text) AS text_md5 FROM k")


def valid_chunk(x: str) -> str:
    s = strip(x)
    return f"(length({s}) >= 50 AND {n_tok(s)} >= 10 AND length({rep(s, r'[^\p{L}\p{N}]', '')})::DOUBLE / length({s}) >= 0.3::DOUBLE)"


def told(x: str, tokens: int, so_far: str = "") -> str:
    """What the extractive backend answers: the first three sentences as bullets, behind the summary so far if there is one."""
    marked = f"regexp_replace({x}, {pat('([.!?]){s}+')}, '\\1' || chr(1), 'g')"
    parts = f"list_filter(list_transform(string_split({marked}, chr(1)), lambda q: {strip('q')}), lambda q: q <> '')"
    bullets_ = f"array_to_string(list_transform(({parts})[1:3], lambda q: CASE WHEN starts_with(q, '- ') THEN q ELSE '- ' || q END), chr(10))"
    whole = f"CASE WHEN {so_far} <> '' THEN {so_far} || chr(10) || {bullets_} ELSE {bullets_} END" if so_far else bullets_
    return chain(f"array_to_string(string_split({whole}, ' ')[1:{tokens}], ' ')", N.SUMMARY_CLEAN)


def distinct_lines(x: str, key=lambda q: q) -> str:
    """Lines whose key occurred before go; blank ones stay."""
    kept = f"list_filter(string_split({x}, chr(10)), lambda l, i: {strip('l')} = '' OR list_position(list_transform(string_split({x}, chr(10)), lambda m: CASE WHEN {strip('m')} = '' THEN NULL ELSE {key(strip('m'))} END), {key(strip('l'))}) = i)"
    return f"array_to_string({kept}, chr(10))"


def chunk_summaries() -> str:
    said = told(f"left(text, {models.CHUNK_CAP})", models.CHUNK_TOKENS)
    return docs(
        *chunk_steps(chunking.MIN_TOKENS),
        f"u AS (SELECT doc_id, chunk_id, {said} AS summary FROM k)",
        final=f"SELECT doc_id, chunk_id::BIGINT AS chunk_id, CASE WHEN length({strip('summary')}) > {models.MIN_SUMMARY} THEN summary END AS summary FROM u",
    )


def folded(start: str, step: list[tuple[str, str]], final: str) -> str:
    """Texts of a conversation one after the other. start: the running text after the first; step: named stages of the
    next, each of which may name those before, the last being the new running text; final: the last one tidied.
    """
    source = "(SELECT r.conv_id, r.i + 1 AS i, r.running, n.text FROM r JOIN n ON n.conv_id = r.conv_id AND n.i = r.i + 1)"
    for name, value in step:
        source = f"(SELECT *, {value} AS {name} FROM {source})"
    return f"""WITH RECURSIVE n AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations WHERE text IS NOT NULL),
    r(conv_id, i, running) AS (SELECT conv_id, 1::BIGINT, {start} FROM n WHERE i = 1 UNION ALL SELECT conv_id, i, {step[-1][0]} FROM {source}),
    e AS (SELECT conv_id, max(i) AS n, arg_max(running, i) AS running FROM r GROUP BY conv_id)
    {final}"""


def merged_summaries() -> str:
    run = f"left(running, {models.RUNNING_CAP})"
    tidied = chain(strip(f"left(running, {models.FINAL_CAP})"), N.SUMMARY_CLEAN)
    return folded("text", [("running2", told("text", models.REFINE_TOKENS, run))], f"SELECT conv_id, n::INT AS n, CASE WHEN n = 1 THEN running ELSE {tidied} END AS summary FROM e")


def refined_fold() -> str:
    tidied = chain(strip(f"left(running, {models.FINAL_CAP})"), N.SUMMARY_CLEAN)
    loose = distinct_lines("t", lambda q: rep(f"lower({q})", LOOSE, ""))
    return folded(
        told(f"left(text, {models.REFINE_CAP})", models.FIRST_TOKENS), REFINED,
        f"SELECT conv_id, n::INT AS n, CASE WHEN {strip('running')} = '' THEN '' ELSE {loose} END AS summary FROM (SELECT *, {tidied} AS t FROM e)",
    )


REFINED = [
    ("fresh", f"CASE WHEN running = '' THEN {told(f'left(text, {models.REFINE_CAP})', models.FIRST_TOKENS)} END"),
    ("more", f"CASE WHEN running <> '' AND {strip('text')} <> '' THEN {told(f'left(text, {models.REFINE_CAP})', models.REFINE_TOKENS, f'left(running, {models.RUNNING_CAP})')} END"),
    ("running2", f"CASE WHEN running = '' THEN fresh WHEN more IS NULL THEN running ELSE {distinct_lines('more')} END"),
]


def walked(name: str, source: str, start: str, step: list[tuple[str, str]]) -> list[str]:
    """name(doc_id, n, running): the texts of source(doc_id, i, text) folded one after the other, as in folded()."""
    rows = f"(SELECT r.doc_id, r.i + 1 AS i, r.running, n.text FROM {name}r r JOIN {source} n ON n.doc_id = r.doc_id AND n.i = r.i + 1)"
    for stage, value in step:
        rows = f"(SELECT *, {value} AS {stage} FROM {rows})"
    return [
        f"{name}r(doc_id, i, running) AS (SELECT doc_id, 1::BIGINT, {start} FROM {source} WHERE i = 1 UNION ALL SELECT doc_id, i, {step[-1][0]} FROM {rows})",
        f"{name} AS (SELECT doc_id, max(i) AS n, arg_max(running, i) AS running FROM {name}r GROUP BY doc_id)",
    ]


def adaptive() -> str:
    """Each document by its route; the texts take the shapes that the query gives them."""
    said = told(f"left(t, {models.CHUNK_CAP})", models.CHUNK_TOKENS)
    enough = f"length({strip('said')}) > {models.MIN_SUMMARY}"
    sections = section_steps("text")
    sections[-1] = sections[-1].replace("{where}", " WHERE lower(name) <> 'references'")
    tidied = chain(strip(f"left(running, {models.FINAL_CAP})"), N.SUMMARY_CLEAN)
    steps = [
        "raw AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        f"d AS (SELECT doc_id, CASE length(text) % 3 WHEN 0 THEN {BOOK} WHEN 1 THEN {PAPER} ELSE text END AS text FROM raw)",
        *kinds("d", "d"),
        "ds2 AS (SELECT doc_id, t, round_even(CASE WHEN t = 'book' THEN b WHEN t = 'paper' THEN p ELSE 1.0::DOUBLE - greatest(b, p) END, 2) AS sure FROM dk)",
        "dr AS (SELECT doc_id, sure, CASE WHEN t = 'book' AND sure > 0.6::DOUBLE THEN 'book' WHEN t = 'paper' AND sure > 0.5::DOUBLE THEN 'paper' ELSE 'general' END AS route FROM ds2)",
        *[f"{kind}d AS (SELECT doc_id, text FROM d JOIN dr USING (doc_id) WHERE route = '{kind}')" for kind in ("book", "paper", "general")],
        *tagged(chapter_steps("text"), "b", "bookd"),
        f"btold AS (SELECT * FROM (SELECT doc_id, pos, number, title, {said} AS said FROM bch WHERE pos < {structure.MAX_CHAPTERS} AND {strip('t')} <> '') WHERE {enough})",
        *tagged(sections, "p", "paperd"),
        f"ptold AS (SELECT * FROM (SELECT doc_id, pos, name, {said} AS said FROM psec WHERE {strip('t')} <> '') WHERE {enough})",
        """seq AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, '### Chapter ' || number || ': ' || title || chr(10) || said AS text FROM btold
          UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, said AS text FROM ptold)""",
        *walked("overview", "seq", "text", [("running2", told("text", models.REFINE_TOKENS, f"left(running, {models.RUNNING_CAP})"))]),
        *tagged(cleaned_steps(CONTROLS, "text"), "z", "generald"),
        "zd AS (SELECT doc_id, t AS text FROM zm)",
        *tagged(chunk_steps(chunking.MIN_TOKENS), "q", "zd"),
        """gseq AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS i, text FROM
          (SELECT doc_id, chunk_id, text FROM qk UNION ALL SELECT doc_id, 0, left(text, 8000) FROM zd WHERE doc_id NOT IN (SELECT doc_id FROM qk)))""",
        *walked("whole", "gseq", told(f"left(text, {models.REFINE_CAP})", models.FIRST_TOKENS), REFINED),
        f"wt AS (SELECT *, {tidied} AS t FROM whole)",
        f"""gout AS (SELECT doc_id, 'general' AS doc_type, NULL AS title, n::INT AS parts,
          CASE WHEN {strip('running')} = '' THEN '' ELSE {distinct_lines('t', lambda q: rep(f'lower({q})', LOOSE, ''))} END AS summary FROM wt)""",
        f"""bout AS (SELECT e.doc_id, 'book' AS doc_type, e.title, e.parts, '# ' || e.title || chr(10) || CASE WHEN e.a <> 'Unknown Author' THEN '**Author:** ' || e.a || chr(10) ELSE '' END
          || '**Chapters:** ' || e.total || ' total, ' || e.parts || ' summarized' || chr(10) || chr(10) || coalesce(o.running, '') AS summary
          FROM (SELECT doc_id, {book_title('text')} AS title, {book_author('text')} AS a, (SELECT count(*) FROM bch WHERE bch.doc_id = bookd.doc_id) AS total,
                (SELECT count(*) FROM btold WHERE btold.doc_id = bookd.doc_id)::INT AS parts FROM bookd) e LEFT JOIN overview o USING (doc_id))""",
        "pnames AS (SELECT doc_id, string_agg(name, ', ' ORDER BY pos) AS names, count(*)::INT AS parts FROM ptold GROUP BY doc_id)",
        f"""pout AS (SELECT e.doc_id, 'paper' AS doc_type, e.title, coalesce(parts, 0) AS parts, '**Title:** ' || e.title || chr(10) || CASE WHEN e.a <> '' THEN '**Authors:** ' || e.a || chr(10) ELSE '' END || chr(10)
          || CASE WHEN coalesce(names, '') <> '' THEN '*Sections covered: ' || names || '*' || chr(10) || chr(10) ELSE '' END || coalesce(o.running, '') AS summary
          FROM (SELECT doc_id, {paper_title('text')} AS title, array_to_string({paper_authors('text')}, ', ') AS a FROM paperd) e LEFT JOIN pnames USING (doc_id) LEFT JOIN overview o USING (doc_id))""",
    ]
    return "WITH RECURSIVE " + ", ".join(steps) + """ SELECT doc_id, doc_type, sure AS confidence, title, parts, summary
      FROM (SELECT * FROM gout UNION ALL SELECT * FROM bout UNION ALL SELECT * FROM pout) JOIN dr USING (doc_id)"""


def words_per_page(x: str) -> str:
    return f"({n_tok(x)}::DOUBLE / 300.0::DOUBLE)"


def book_score(x: str) -> str:
    p = words_per_page(x)
    hits = " + ".join(f"len(regexp_extract_all({x}, {pat(q)}))" for q in detect.BOOK_PATTERNS)
    nums = f"list_transform(regexp_extract_all({x}, {pat(detect.CHAPTER_NUMBER)}, 1)[1:10], lambda q: q::HUGEINT)"
    run = f"(len({nums}) > 1 AND {nums} = list_transform(range(0, len({nums})), lambda q: ({nums})[1] + q))"
    return f"""least((CASE WHEN {p} >= 100 THEN 0.3 WHEN {p} >= 50 THEN 0.2 WHEN {p} >= 30 THEN 0.1 ELSE 0.0 END)::DOUBLE
      + (CASE WHEN {hits} >= 5 THEN 0.4 WHEN {hits} >= 3 THEN 0.3 WHEN {hits} >= 1 THEN 0.15 ELSE 0.0 END)::DOUBLE
      + (CASE WHEN {run} THEN 0.2 ELSE 0.0 END)::DOUBLE + (CASE WHEN {has(x, detect.CONTENTS)} THEN 0.1 ELSE 0.0 END)::DOUBLE, 1.0::DOUBLE)"""


def paper_score(x: str) -> str:
    found = " + ".join(f"{has(x, detect.SECTION.replace('{name}', f'(?:{s})'))}::INT" for s in detect.PAPER_SECTIONS)
    word = lambda n: has(x, detect.WHOLE_WORD.replace("{name}", n))
    authors = " + ".join(f"(CASE WHEN {has(x, p)} THEN 0.05 ELSE 0.0 END)::DOUBLE" for p in detect.AUTHORS)
    return f"""least(({found})::DOUBLE / 8.0::DOUBLE * 0.5::DOUBLE + (CASE WHEN {word("Abstract")} THEN CASE WHEN {has(x, detect.LONG_ABSTRACT)} THEN 0.25 ELSE 0.1 END ELSE 0.0 END)::DOUBLE
      + (CASE WHEN {word("References?")} THEN 0.15 ELSE 0.0 END)::DOUBLE + {authors}, 1.0::DOUBLE)"""


def kinds(source: str, tag: str = "") -> list[str]:
    """s and k, with that tag before their names: the scores and the kind of each text of source."""
    return [
        f"{tag}s AS (SELECT doc_id, {n_tok('text')} AS words, {book_score('text')} AS b, {paper_score('text')} AS p FROM {source})",
        f"{tag}k AS (SELECT *, CASE WHEN b > 0.6::DOUBLE AND b > p THEN 'book' WHEN p > 0.5::DOUBLE THEN 'paper' ELSE 'general' END AS t FROM {tag}s)",
    ]


def detected(like: str) -> str:
    return docs(
        f"e AS (SELECT doc_id, {like} AS text FROM d)",
        *kinds("e"),
        "c AS (SELECT *, CASE WHEN t = 'book' THEN b WHEN t = 'paper' THEN p ELSE 1.0::DOUBLE - greatest(b, p) END AS sure FROM k)",
        final="""SELECT doc_id, t AS doc_type, round(sure, 6) AS confidence, round(words::DOUBLE / 300.0::DOUBLE, 6) AS pages, words,
          CASE WHEN t = 'book' THEN b > 0.7::DOUBLE END AS has_chapters, CASE WHEN t = 'paper' THEN p > 0.7::DOUBLE END AS has_abstract,
          CASE WHEN t = 'book' AND sure > 0.6::DOUBLE THEN 'book' WHEN t = 'paper' AND sure > 0.5::DOUBLE THEN 'paper' ELSE 'general' END AS route FROM c""",
    )


_HEADER = structure.HEADER
_TITLE = "array_to_string(list_transform(string_split(lower(n), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def section_steps(like: str) -> list[str]:
    return [
        f"e AS (SELECT doc_id, {like} AS text FROM d)",
        f"n AS (SELECT doc_id, text, regexp_extract_all(text, {pat(_HEADER)}, 1) AS ns, string_split_regex(text, {pat(_HEADER)}) AS bs FROM e)",
        "x AS (SELECT doc_id, unnest(ns) AS n, generate_subscripts(ns, 1) AS i, bs FROM n)",
        f"y AS (SELECT doc_id, {_TITLE} AS name, i, left({strip('bs[i + 1]')}, {structure.SECTION_CAP}) AS t FROM x)",
        "z AS (SELECT doc_id, name, min(i) AS i, arg_max(t, i) AS t FROM y WHERE t <> '' GROUP BY doc_id, name)",
        "u AS (SELECT doc_id, name, i, t FROM z UNION ALL SELECT doc_id, 'body', 1, text FROM n WHERE len(ns) = 0)",
        "sec AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, name, t FROM u{where})",
    ]


def section_rows(where: str = "") -> str:
    steps = section_steps(PAPER)
    steps[-1] = steps[-1].replace("{where}", where)
    return docs(*steps, final="SELECT doc_id, pos, name, length(t) AS n_chars, md5(t) AS text_md5 FROM sec")


_CHAPTER = structure.CHAPTER


def chapter_steps(like: str) -> list[str]:
    return [
        f"e AS (SELECT doc_id, {like} AS text FROM d)",
        f"n AS (SELECT doc_id, text, regexp_extract_all(text, {pat(_CHAPTER)}, 1) AS ns, regexp_extract_all(text, {pat(_CHAPTER)}, 2) AS ts, string_split_regex(text, {pat(_CHAPTER)}) AS bs FROM e)",
        "x AS (SELECT doc_id, unnest(ns) AS number, generate_subscripts(ns, 1) AS i, ts, bs FROM n)",
        f"""ch AS (SELECT doc_id, i - 1 AS pos, number, left({strip('ts[i]')}, 100) AS title, left({strip('bs[i + 1]')}, {structure.CHAPTER_CAP}) AS t FROM x
          UNION ALL SELECT doc_id, 0, '1', 'Full Text', left(text, {structure.WHOLE_CAP}) FROM n WHERE len(ns) = 0)""",
    ]


def first_of(ls: str, n: int, test: str, cap: str = "") -> str:
    found = f"list_filter(list_transform((string_split({ls}, chr(10)))[1:{n}], lambda l: {strip('l')}), lambda l: {test})[1]"
    return f"coalesce({f'left({found}, {cap})' if cap else found}, 'Unknown Title')"


_CAP = has("l", r"^\p{Lu}")
_ALL = f"({has('l', r'\p{Lu}')} AND NOT {has('l', r'[\p{Ll}\p{Lt}]')})"


def paper_title(x: str) -> str:
    return first_of(x, 10, f"length(l) BETWEEN 20 AND 200 AND {_CAP}", "150")


def book_title(x: str) -> str:
    return first_of(x, 20, f"({_ALL} AND length(l) > 10 AND length(l) < 100) OR ({_CAP} AND length(l) > 20 AND length(l) < 150)")


def paper_authors(x: str) -> str:
    """In order of first place; the first three."""
    both = " || ".join(f"regexp_extract_all({x}, {pat(p)}, 1)" for p in structure.PAPER_AUTHORS)
    return f"list_filter({both}, lambda a, i: list_position({both}, a) = i)[1:3]"


def book_author(x: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {pat(p)}, 1), '')" for p in structure.BOOK_AUTHORS) + ", 'Unknown Author')"


def syllables(w: str) -> str:
    bare = f"replace(lower({w}), '-', '')"
    groups = f"len(regexp_extract_all({bare}, '[aeiouy]+'))"
    return f"CASE WHEN length({bare}) <= 3 THEN 1 ELSE greatest({groups} - CASE WHEN ends_with({bare}, 'e') AND {groups} > 1 THEN 1 ELSE 0 END, 1) END"


def flesch_steps(x: str, source: str, name: str) -> list[str]:
    return [
        f"{name}0 AS (SELECT doc_id, {x} AS s FROM {source})",
        f"{name}1 AS (SELECT doc_id, s, {bullets('s')} AS n FROM {name}0)",
        f"{name}2 AS (SELECT doc_id, s, regexp_extract_all({plain('n')}, {pat(metrics.WORD)}) AS w, list_filter(list_transform(string_split_regex(n, '[.!?]+'), lambda q: {strip('q')}), lambda q: length(q) > 5) AS ss FROM {name}1)",
        f"{name}3 AS (SELECT doc_id, s, len(w) AS nw, len(ss) AS ns, coalesce(list_sum(list_transform(w, lambda v: {syllables('v')})), 0) AS ny FROM {name}2)",
        f"""{name} AS (SELECT doc_id, CASE WHEN length({strip('s')}) < 50 OR ns = 0 OR nw < 10 THEN 50.0::DOUBLE ELSE
          greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * (nw::DOUBLE / ns) - 84.6::DOUBLE * (ny::DOUBLE / nw))) END AS v FROM {name}3)""",
    ]


_COMMON = ", ".join(f"'{w}'" for w in sorted(set(metrics.COMMON)))


def content(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({tok(f'lower({x})')}, lambda q: {rep('q', '{W}', '')}), lambda q: length(q) >= 3 AND q NOT IN ({_COMMON})))"


def coverage(a: str, b: str) -> str:
    share = f"least(1.0::DOUBLE, len(list_intersect({content(a)}, {content(b)}))::DOUBLE / len({content(a)}) * 1.3::DOUBLE)"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN len({content(a)}) = 0 THEN 0.5::DOUBLE ELSE {share} END"


def redundancy_steps(x: str, source: str, name: str) -> list[str]:
    return [
        f"{name}0 AS (SELECT doc_id, {x} AS s FROM {source})",
        f"{name}1 AS (SELECT doc_id, s, list_transform(list_filter(list_transform(string_split_regex({bullets('s')}, '[.!?]+'), lambda q: {strip('q')}), lambda q: length(q) > 15), lambda q: lower(q)) AS ss FROM {name}0)",
        f"{name} AS (SELECT doc_id, CASE WHEN {n_tok('s')} < 50 OR len(ss) < 2 THEN 0.0::DOUBLE ELSE (len(ss) - len(list_distinct(ss)))::DOUBLE / len(ss) END AS v FROM {name}1)",
    ]


def density(x: str) -> str:
    terms = f"len(list_distinct(regexp_extract_all({plain(f'lower({x})')}, {pat(metrics.TERM)})))"
    return f"CASE WHEN {n_tok(x)} = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {terms}::DOUBLE / {n_tok(x)} * 2.0::DOUBLE) END"


def compression(a: str, b: str) -> str:
    return f"({n_tok(a)}::DOUBLE / greatest({n_tok(b)}, 1))"


def penalty(a: str, b: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - abs({n_tok(b)}::DOUBLE / greatest({n_tok(a)}, 1) - 0.15::DOUBLE) * 3.0::DOUBLE))"


def evaluated() -> str:
    return docs(
        f"e AS (SELECT doc_id, text, {condensed('text')} AS sm FROM d)",
        *flesch_steps("sm", "e", "fl"),
        *redundancy_steps("sm", "e", "rd"),
        f"q AS (SELECT doc_id, text, sm, {n_tok('text')} AS ow, {n_tok('sm')} AS sw, {compression('text', 'sm')} AS c, {coverage('text', 'sm')} AS cov, {density('sm')} AS den, {penalty('text', 'sm')} AS pen FROM e)",
        "z AS (SELECT q.*, fl.v AS ease, rd.v AS red, text = '' OR sm = '' AS none FROM q JOIN fl USING (doc_id) JOIN rd USING (doc_id))",
        final="""SELECT doc_id, round(CASE WHEN none THEN 0.0 ELSE c END, 6) AS compression_ratio, round(CASE WHEN none THEN 0.0 ELSE cov END, 6) AS coverage,
          round(CASE WHEN none THEN 0.0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * 0.20::DOUBLE + cov * 0.25::DOUBLE + least(1.0::DOUBLE, c / 5.0::DOUBLE) * 0.20::DOUBLE
            + den * 0.15::DOUBLE + (1.0::DOUBLE - least(0.3::DOUBLE, red)) * 0.10::DOUBLE + pen * 0.10::DOUBLE)) END, 6) AS overall_score,
          round(CASE WHEN none THEN 50.0 ELSE ease END, 6) AS readability_flesch, round(CASE WHEN none THEN 0.0 ELSE red END, 6) AS redundancy,
          round(CASE WHEN none THEN 0.0 ELSE den END, 6) AS density, CASE WHEN NOT none THEN round(pen, 6) END AS length_penalty,
          CASE WHEN NOT none THEN ow END AS original_words, CASE WHEN NOT none THEN sw END AS summary_words FROM z""",
    )


PASSAGES = "p AS (SELECT vec_id // 10 AS passage, vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
ADJACENT = "a AS (SELECT passage, row_number() OVER w - 1 AS pos, list_cosine_similarity(v, lead(v) OVER w) AS c FROM p WINDOW w AS (PARTITION BY passage ORDER BY vec_id))"


def adjacent() -> str:
    return f"WITH {PASSAGES}, {ADJACENT} SELECT passage, pos, round(c, 6) AS cosine FROM a WHERE c IS NOT NULL"


def group_threshold() -> str:
    return f"""WITH {PASSAGES}, {ADJACENT}, s AS (SELECT passage, avg(c + 0.5::DOUBLE) AS m, stddev_pop(c + 0.5::DOUBLE) AS sd FROM a GROUP BY passage)
    SELECT passage, round(CASE WHEN m IS NULL OR sd = 0 THEN 0.4::DOUBLE ELSE greatest(0.35::DOUBLE, m - 0.15::DOUBLE * sd) END, 6) AS threshold FROM s"""


def greedy(threshold: float) -> str:
    """A passage's vectors one after the other: each step keeps the next if none that stayed is nearer than the threshold."""
    return f"""WITH RECURSIVE {PASSAGES}, n AS (SELECT passage, vec_id, v, row_number() OVER (PARTITION BY passage ORDER BY vec_id) AS i FROM p),
    k(passage, i, ids, vs) AS (
      SELECT passage, 1, [vec_id], [v] FROM n WHERE i = 1
      UNION ALL
      SELECT k.passage, k.i + 1, CASE WHEN near THEN ids ELSE list_append(ids, vec_id) END, CASE WHEN near THEN vs ELSE list_append(vs, v) END
      FROM (SELECT k.passage, k.i, k.ids, k.vs, n.vec_id, n.v, len(list_filter(k.vs, lambda x: list_cosine_similarity(x, n.v) > {threshold}::DOUBLE)) > 0 AS near
            FROM k JOIN n ON n.passage = k.passage AND n.i = k.i + 1) k)
    SELECT passage, unnest(ids) AS vec_id FROM (SELECT passage, arg_max(ids, i) AS ids FROM k GROUP BY passage)"""


def whole_greedy(threshold: float, group: str, select: str) -> str:
    """The same for each group of all embeddings."""
    return f"""WITH RECURSIVE n AS (SELECT {group} AS g, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY {group} ORDER BY vec_id) AS i FROM embeddings),
    k(g, i, ids, vs) AS (
      SELECT g, 1::BIGINT, [vec_id], [v] FROM n WHERE i = 1
      UNION ALL
      SELECT g, i, CASE WHEN near THEN ids ELSE list_append(ids, vec_id) END, CASE WHEN near THEN vs ELSE list_append(vs, v) END
      FROM (SELECT n.g, n.i, k.ids, k.vs, n.vec_id, n.v, len(list_filter(k.vs, lambda x: list_cosine_similarity(x, n.v) > {threshold}::DOUBLE)) > 0 AS near
            FROM k JOIN n ON n.g = k.g AND n.i = k.i + 1))
    SELECT {select} FROM (SELECT g, arg_max(ids, i) AS ids FROM k GROUP BY g)"""


def paged_documents(lines: int = 20) -> str:
    page = strip(f"array_to_string(ls[i * {lines} + 1:i * {lines} + {lines}], chr(10))")
    return docs(
        "l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)",
        f"g AS (SELECT doc_id, list_transform(range(0, (len(ls) - 1) // {lines} + 1), lambda i: {page}) AS ps FROM l)",
        "j AS (SELECT doc_id, len(ps) AS n, array_to_string(list_filter(ps, lambda p: p <> ''), chr(10) || chr(10)) AS t FROM g)",
        final="SELECT doc_id, n::INT AS n_pages, 0 AS missing, 'whole' AS status, length(t) AS n_chars, md5(t) AS text_md5 FROM j",
    )


CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT)"""


def word_vectors(name: str, source: str, key: str, dim: int) -> list[str]:
    """name(key, v): the dense vectors of signed word counts of source(key, t); each word is hashed once."""
    return [
        f"{name}w AS (SELECT {key}, unnest({tok('lower(t)')}) AS w FROM {source})",
        f"{name}h AS (SELECT w, {CRC32} AS h FROM (SELECT DISTINCT w FROM {name}w))",
        f"{name}p AS (SELECT {key}, h % {dim} AS place, sum(2 * (h >> 31) - 1)::DOUBLE AS x FROM {name}w JOIN {name}h USING (w) GROUP BY ALL)",
        f"{name}m AS (SELECT {key}, map_from_entries(list((place, x))) AS m FROM {name}p GROUP BY {key})",
        f"{name} AS (SELECT {', '.join('s.' + k.strip() for k in key.split(','))}, list_transform(range(0, {dim}), lambda k: coalesce(m[k], 0.0::DOUBLE)) AS v FROM {source} s LEFT JOIN {name}m USING ({key}))",
    ]


def by_meaning(most: int, overlap: int, dim: int) -> str:
    """Sentences walked twice: once with the sum of the open group, once with what the open chunk, the open cut and the closed chunks hold."""
    cos = lambda a, b: f"(CASE WHEN list_dot_product({a}, {a}) * list_dot_product({b}, {b}) = 0 THEN 0.0::DOUBLE ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END)"
    total = lambda xs: f"list_reduce(list_prepend(0.0::DOUBLE, {xs}), lambda a, x: a + x)"
    words = lambda ids: f"coalesce(list_sum(list_transform({ids}, lambda z: cs[z + 1])), 0)"
    tail = lambda ids: f"{ids}[-{overlap}:]" if overlap else "[]::BIGINT[]"
    steps = [
        f"s AS (SELECT doc_id, list_transform({sentences(abbreviations('text'))}, lambda y: replace(y, chr(2), '.')) AS xs FROM d)",
        "r AS (SELECT doc_id, unnest(xs) AS t, generate_subscripts(xs, 1) - 1 AS i FROM s)",
        *word_vectors("e", "r", "doc_id, i", dim),
        f"n AS (SELECT doc_id, list(c ORDER BY i) AS ns FROM (SELECT a.doc_id, a.i, {cos('a.v', 'b.v')} AS c FROM e a JOIN e b ON b.doc_id = a.doc_id AND b.i = a.i + 1) GROUP BY doc_id)",
        f"n2 AS (SELECT doc_id, ns, {total('ns')} / len(ns) AS mean FROM n)",
        f"n3 AS (SELECT doc_id, mean, sqrt({total('list_transform(ns, lambda x: (x - mean) * (x - mean))')} / len(ns)) AS sd FROM n2)",
        "th AS (SELECT s.doc_id, len(xs) AS total, CASE WHEN sd IS NULL OR sd = 0 THEN 0.4::DOUBLE ELSE greatest(0.35::DOUBLE, mean - 0.15::DOUBLE * sd) END AS least FROM s LEFT JOIN n3 USING (doc_id))",
        f"""gr(doc_id, i, sum, n, g) AS (SELECT doc_id, i, v, 1, 0 FROM e WHERE i = 0
          UNION ALL SELECT doc_id, i, CASE WHEN opens THEN v ELSE list_transform(v, lambda x, k: x + sum[k]) END, CASE WHEN opens THEN 1 ELSE n + 1 END, CASE WHEN opens THEN g + 1 ELSE g END
          FROM (SELECT e.doc_id, e.i, e.v, gr.sum, gr.n, gr.g, total > 3 AND gr.n >= 2 AND {cos('gr.sum', 'e.v')} < least AS opens FROM gr JOIN e ON e.doc_id = gr.doc_id AND e.i = gr.i + 1 JOIN th ON th.doc_id = gr.doc_id))""",
        f"c AS (SELECT r.doc_id, r.i, g, {n_tok('t')} AS c FROM r JOIN gr ON gr.doc_id = r.doc_id AND gr.i = r.i)",
        "o AS (SELECT doc_id, g, min(i) AS b, max(i) AS e, sum(c) AS w FROM c GROUP BY doc_id, g)",
        "al AS (SELECT doc_id, list(c ORDER BY i) AS cs, max(g) AS top FROM c GROUP BY doc_id)",
        "it AS (SELECT c.doc_id, c.i, c.c, c.i = o.b AS head, c.i = o.e AS foot, w, c.g = top AS final, cs FROM c JOIN o ON o.doc_id = c.doc_id AND o.g = c.g JOIN al ON al.doc_id = c.doc_id)",
        f"""pk(doc_id, i, open, cut, out) AS (SELECT doc_id, -1::BIGINT, []::BIGINT[], []::BIGINT[], []::STRUCT(ids BIGINT[], ends BOOLEAN)[] FROM al
          UNION ALL SELECT doc_id, i,
            CASE WHEN heavy THEN open WHEN over THEN list_append({tail('open')}, i) ELSE list_append(open, i) END,
            CASE WHEN NOT heavy THEN cut WHEN foot THEN []::BIGINT[] ELSE cut2 END,
            CASE WHEN NOT heavy THEN CASE WHEN over AND len(open) > 0 THEN list_append(out, {{'ids': open, 'ends': false}}) ELSE out END
                 WHEN foot THEN list_append(out2, {{'ids': cut2, 'ends': final}}) ELSE out2 END
          FROM (SELECT *, list_append(CASE WHEN head THEN []::BIGINT[] WHEN over THEN {tail('cut')} ELSE cut END, i) AS cut2, CASE WHEN over THEN list_append(out, {{'ids': cut, 'ends': false}}) ELSE out END AS out2
            FROM (SELECT *, CASE WHEN heavy THEN NOT head AND {words('cut')} + c > {most} ELSE head AND {words('open')} + w > {most} END AS over
              FROM (SELECT it.*, pk.open, pk.cut, pk.out, w > {most} AS heavy FROM pk JOIN it ON it.doc_id = pk.doc_id AND it.i = pk.i + 1))))""",
        "ot AS (SELECT doc_id, CASE WHEN len(open) > 0 THEN list_append(out, {'ids': open, 'ends': true}) ELSE out END AS cs FROM (SELECT doc_id, arg_max(open, i) AS open, arg_max(out, i) AS out FROM pk GROUP BY doc_id))",
        "ch AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS chunk_id FROM ot)",
        f"tx AS (SELECT ch.doc_id, chunk_id, c.ends AS ends, {strip(chr(34) + 'j' + chr(34))} AS t FROM (SELECT ch.*, array_to_string(list_transform(c.ids, lambda z: xs[z + 1]), ' ') AS j FROM ch JOIN s USING (doc_id)) ch)",
        "fx AS (SELECT doc_id, chunk_id, CASE WHEN t <> '' AND NOT ends AND NOT regexp_matches(t, '[.!?]$') THEN t || '.' ELSE t END AS t FROM tx)",
    ]
    return docs(*steps, final=f"SELECT doc_id, chunk_id::INT AS chunk_id, ({n_tok('t')})::INT AS token_count, md5(t) AS text_md5 FROM fx").replace("WITH ", "WITH RECURSIVE ", 1)


def even(x: str, digits: int) -> str:
    """x rounded half to even by its decimal digits, not by a product of binary numbers."""
    scaled = f"({x})::DOUBLE::VARCHAR::DECIMAL(30, 20) * {10**digits}::DECIMAL(6, 0)"
    return f"list_transform([{scaled}], lambda y: (floor(y) + CASE WHEN y - floor(y) > 0.5 OR (y - floor(y) = 0.5 AND floor(y) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / {10**digits}.0::DOUBLE)[1]"


def final_events() -> str:
    """The final events by the offline models: chunk summaries, those of them that stay, their merge, and its scores against the clean text."""
    said = told(f"left(CASE WHEN total > 4 THEN t ELSE left(t, 8000) END, {models.CHUNK_CAP})", models.CHUNK_TOKENS)
    tidied = chain(strip(f"left(running, {models.FINAL_CAP})"), N.SUMMARY_CLEAN)
    zero = lambda x: f"CASE WHEN none THEN 0.0::DOUBLE ELSE {x} END"
    start = events("SELECT 1").removeprefix("WITH ").removesuffix(" SELECT 1").replace("valid AS (SELECT doc_id,", "valid AS (SELECT doc_id, text,", 1)
    steps = [
        f"su AS (SELECT doc_id, i, {said} AS text FROM (SELECT doc_id, i, text AS t, total FROM valid JOIN head USING (doc_id)))",
        f"good AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, text AS t FROM su WHERE length({strip('text')}) > {models.MIN_SUMMARY})",
        *word_vectors("ev", "good", "doc_id, i", 256),
        "gv AS (SELECT doc_id, i, t, v FROM good JOIN ev USING (doc_id, i))",
        """st(doc_id, i, ts, vs) AS (SELECT doc_id, i, [t], [v] FROM gv WHERE i = 1
          UNION ALL SELECT doc_id, i, CASE WHEN near THEN ts ELSE list_append(ts, t) END, CASE WHEN near THEN vs ELSE list_append(vs, v) END
          FROM (SELECT gv.doc_id, gv.i, gv.t, gv.v, st.ts, st.vs, len(list_filter(st.vs, lambda x: list_dot_product(x, gv.v) > 0.75::DOUBLE * sqrt(list_dot_product(x, x) * list_dot_product(gv.v, gv.v)))) > 0 AS near FROM st JOIN gv ON gv.doc_id = st.doc_id AND gv.i = st.i + 1))""",
        "kt AS (SELECT doc_id, max(i) AS n_good, arg_max(ts, i) AS ts FROM st GROUP BY doc_id)",
        "seq AS (SELECT doc_id, unnest(ts) AS text, generate_subscripts(ts, 1)::BIGINT AS i FROM kt)",
        *walked("mg", "seq", "text", [("running2", told("text", models.REFINE_TOKENS, f"left(running, {models.RUNNING_CAP})"))]),
        f"sm AS (SELECT d.doc_id, d.text, {chain('m', N.READABILITY)} AS sm, n_good FROM (SELECT d.doc_id, text, coalesce(n_good, 0) AS n_good, coalesce(CASE WHEN n = 1 THEN running ELSE {tidied} END, '') AS m FROM d LEFT JOIN kt USING (doc_id) LEFT JOIN mg USING (doc_id)) d)",
        "ta AS (SELECT doc_id, left(text, 8000) AS t FROM sm)", "tb AS (SELECT doc_id, left(sm, 8000) AS t FROM sm)",
        *word_vectors("va", "ta", "doc_id", 256), *word_vectors("vb", "tb", "doc_id", 256),
        "co AS (SELECT va.doc_id, CASE WHEN list_dot_product(va.v, va.v) * list_dot_product(vb.v, vb.v) = 0 THEN 0.0::DOUBLE ELSE list_dot_product(va.v, vb.v) / sqrt(list_dot_product(va.v, va.v) * list_dot_product(vb.v, vb.v)) END AS cos FROM va JOIN vb USING (doc_id))",
        *flesch_steps("sm", "sm", "fl"),
        *redundancy_steps("sm", "sm", "rd"),
        f"q AS (SELECT doc_id, sm, n_good, {n_tok('sm')} AS sw, {compression('text', 'sm')} AS c, {even(coverage('text', 'sm'), 4)} AS cov, {even(density('sm'), 4)} AS den, {penalty('text', 'sm')} AS pen, sm = '' AS none FROM sm)",
        f"z AS (SELECT q.*, fl.v AS ease, {even('rd.v', 4)} AS red, cos FROM q JOIN fl USING (doc_id) JOIN rd USING (doc_id) JOIN co USING (doc_id))",
        "sure AS (SELECT doc_id, t AS doc_type, words, round_even(CASE WHEN t = 'book' THEN b WHEN t = 'paper' THEN p ELSE 1.0::DOUBLE - greatest(b, p) END, 2) AS confidence FROM dk)",
    ]
    overall = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, cos * 0.20::DOUBLE + cov * 0.25::DOUBLE + least(1.0::DOUBLE, c / 5.0::DOUBLE) * 0.20::DOUBLE + den * 0.15::DOUBLE + (1.0::DOUBLE - least(0.3::DOUBLE, red)) * 0.10::DOUBLE + pen * 0.10::DOUBLE))"
    return "WITH RECURSIVE " + ", ".join([start, *steps]) + f""" SELECT doc_id, doc_type, confidence, total::INT AS total_chunks, n_good::INT AS chunks_summarized,
      round(sure.words::DOUBLE / greatest(sw, 1), 1) AS compression, sm AS summary, {zero(even('cos', 4))} AS cosine_similarity, {zero('cov')} AS coverage, {zero('den')} AS density, {zero('red')} AS redundancy,
      CASE WHEN none THEN 50.0::DOUBLE ELSE {even('ease', 2)} END AS readability_flesch, CASE WHEN NOT none THEN {even('pen', 4)} END AS length_penalty, {zero(even(overall, 4))} AS overall_score
      FROM z JOIN sure USING (doc_id) JOIN (SELECT doc_id, total FROM head) h USING (doc_id)"""


def layouts() -> str:
    chapters = chapter_steps(BOOK)
    sections = section_steps(PAPER)
    rename = lambda steps, tag: [s.replace(" FROM e", f" FROM e{tag}").replace(" FROM n", f" FROM n{tag}").replace(" FROM x", f" FROM x{tag}") for s in steps]
    named = lambda steps, tag: [s if s.startswith(("ch ", "sec ", "y ", "z ", "u ")) else s[0] + tag + s[1:] for s in rename(steps, tag)]
    sections[-1] = sections[-1].replace("{where}", " WHERE lower(name) <> 'references'")
    return docs(
        *named(chapters, "b"),
        *named(sections, "p"),
        f"cb AS (SELECT doc_id, count(*) AS total, count(CASE WHEN pos < {structure.MAX_CHAPTERS} AND {strip('t')} <> '' THEN 1 END) AS told FROM ch GROUP BY doc_id)",
        "sp AS (SELECT doc_id, string_agg(name, ', ' ORDER BY pos) AS names FROM sec GROUP BY doc_id)",
        f"o AS (SELECT doc_id, {condensed('text')} AS sm FROM d)",
        f"tb AS (SELECT doc_id, {book_title('text')} AS t, {book_author('text')} AS a FROM eb)",
        f"tp AS (SELECT doc_id, {paper_title('text')} AS t, array_to_string({paper_authors('text')}, ', ') AS a FROM ep)",
        final="""SELECT o.doc_id, md5('# ' || tb.t || chr(10) || CASE WHEN tb.a <> 'Unknown Author' THEN '**Author:** ' || tb.a || chr(10) ELSE '' END
          || '**Chapters:** ' || total || ' total, ' || told || ' summarized' || chr(10) || chr(10) || sm) AS book_md5,
          md5('**Title:** ' || tp.t || chr(10) || CASE WHEN tp.a <> '' THEN '**Authors:** ' || tp.a || chr(10) ELSE '' END || chr(10)
          || CASE WHEN coalesce(names, '') <> '' THEN '*Sections covered: ' || names || '*' || chr(10) || chr(10) ELSE '' END || sm) AS paper_md5
          FROM o JOIN tb USING (doc_id) JOIN tp USING (doc_id) JOIN cb USING (doc_id) LEFT JOIN sp USING (doc_id)""",
    )


def sql() -> dict[str, str]:
    c = condensed("text")
    nt = n_tok("text")
    page_ok = lambda x, n: f"(length({x}) >= {n} AND CASE WHEN {n_tok(x)} = 0 THEN true ELSE length({rep(x, '{s}', '')})::DOUBLE / {n_tok(x)} <= 20.0::DOUBLE END AND length({rep(x, '[^aeiouAEIOU]', '')})::DOUBLE / greatest(length({x}), 1) >= 0.05::DOUBLE)"
    stripped_pages = f"list_filter(list_transform(string_split(text, chr(10)), lambda p: {strip('p')}), lambda p: p <> '')"
    blank = f"list_filter(list_transform(string_split_regex(f, {pat(chr(92) + 'n{s}*' + chr(92) + 'n+')}), lambda p: {strip('p')}), lambda p: p <> '')"
    by_section = f"list_filter(list_transform(string_split(regexp_replace(f, {pat('(' + chr(92) + 'n{d}+' + chr(92) + '.{d}+{s}+[A-Z])')}, chr(1) || '\\1', 'g'), chr(1)), lambda p: {strip('p')}), lambda p: p <> '')"
    return {
        "src_documents": text_md5("text"),
        "ingest_gate": text_md5(f"CASE WHEN length({strip('text')}) < 50 THEN '' ELSE text END"),
        "join_pages": text_md5(f"array_to_string({stripped_pages}, chr(10) || chr(10))"),
        "page_ranges": docs(f"p AS (SELECT CASE WHEN {page_ok('text', 50)} THEN {strip('text')} ELSE 'recognised' END AS t FROM d)", final="SELECT md5(t) AS text_md5, length(t) AS n_chars, count(*) AS n FROM p GROUP BY ALL"),
        "page_fallback": text_md5(f"array_to_string(list_filter(list_transform(list_transform(string_split(text, chr(10)), lambda p: CASE WHEN {page_ok('p', 50)} THEN {strip('p')} ELSE 'recognised' END), lambda p: {strip('p')}), lambda p: p <> ''), chr(10) || chr(10))"),
        "ordered_concat": f"""WITH t AS (SELECT conv_id, turn, {strip("coalesce(text, '')")} AS s FROM conversations), m AS (SELECT conv_id, coalesce(string_agg(CASE WHEN s <> '' THEN s END, chr(10) || chr(10) ORDER BY turn), '') AS t FROM t GROUP BY conv_id)
          SELECT conv_id, length(t) AS n_chars, md5(t) AS text_md5 FROM m""",
        "filter_text_valid": of_text(valid=page_ok("text", 100)),
        "filter_valid_chunk": of_text(valid=valid_chunk("text")),
        "gate_short_docs": of_text(passes="length(text) >= 100"),
        "gate_summaries": of_text(accepted=f"length({strip(c)}) > 20", kept=f"length({strip(c)}) > 10"),
        "filter_data_rows": of_lines(kept=data_row("line")),
        "flag_boilerplate_lines": of_lines(boilerplate=boilerplate("line", canonical("line"))),
        "filter_symbol_lines": of_lines(kept=symbol_ok("line")),
        "filter_page_numbers": of_lines(kept=f"NOT {page_number('line')}"),
        "filter_short_sentences": docs(*pieces(), final="SELECT doc_id, pos, tokens AS n_tokens FROM p"),
        "sent_light_cleanup": text_md5(light("text")),
        "norm_newlines": text_md5(chain("text", N.NEWLINES), OCR),
        "norm_missing_spaces": text_md5(chain("text", N.MISSING_SPACES), OCR),
        "norm_fix_ocr_text": text_md5(chain("text", N.AFTER_STOPS), OCR),
        "norm_dehyphenate": text_md5(chain("text", N.DEHYPHENATE), OCR),
        "norm_nfkd": text_md5(nfkd("text")),
        "norm_strip_control": text_md5(chain("text", N.CONTROL), OCR),
        "norm_canonical_line": of_lines(canonical=canonical("line")),
        "norm_ligatures": text_md5(ligatures("text"), OCR),
        "ocr_glyph_fix": text_md5(chain("text", N.GLYPHS), OCR),
        "ocr_clean": text_md5(chain("text", N.OCR_CLEAN), OCR),
        "lines_to_paragraphs": docs(f"e AS (SELECT doc_id, list_transform({lines('text')}, lambda l: {strip('l')}) AS ls FROM d)", f"m AS (SELECT doc_id, {paragraphs('ls')} AS t FROM e)", final="SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM m"),
        "squeeze_paragraphs": docs(f"o AS (SELECT doc_id, {OCR} AS text FROM d)", f"e AS (SELECT doc_id, list_transform({lines('text')}, lambda l: {strip('l')}) AS ls FROM o)", f"f AS (SELECT doc_id, {paragraphs('ls')} AS text FROM e)", f"m AS (SELECT doc_id, {per_paragraph('text')} AS t FROM f)", final="SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM m"),
        "clean_documents": cleaned(r"[\x00-\x1f\x7f]"),
        "clean_documents_keep_lines": cleaned(r"[\x00-\x09\x0b-\x1f\x7f]"),
        "chunk_clean": text_md5(chain("text", N.CHUNK_CLEAN)),
        "summary_clean": text_md5(chain("text", N.SUMMARY_CLEAN), NOTED),
        "summary_readability_fix": text_md5(chain("text", N.READABILITY), NOTED),
        "metric_bullet_normalize": text_md5(bullets("text"), NOTED),
        "truncations": of_text(**{f"md5_{n}": f"md5(left(text, {n}))" for n in (150, 3000, 4000, 6000, 8000, 12000)}),
        "dedup_lines_exact": first_lines("s"),
        "dedup_lines_normalized": first_lines(rep("lower(s)", LOOSE, "")),
        "remove_repeated_lines": repeated(0.05, 0.9),
        "remove_repeated_lines_default": repeated(0.5, 0.2),
        "count_tokens": of_text(n_tokens=nt),
        "split_paragraphs": docs(
            f"e AS (SELECT doc_id, regexp_replace({SECTIONED}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS f FROM d)",
            f"a AS (SELECT doc_id, CASE WHEN len({blank}) >= 3 THEN {blank} WHEN len({by_section}) >= 2 THEN {by_section} ELSE {sentences('f')} END AS xs FROM e)",
            "r AS (SELECT doc_id, unnest(xs) AS t, generate_subscripts(xs, 1) - 1 AS pos FROM a)",
            final="SELECT doc_id, pos, length(t) AS n_chars, md5(t) AS text_md5 FROM r",
        ),
        "split_sentences": of_array(f"list_transform({sentences(abbreviations('text'))}, lambda y: replace(y, chr(2), '.'))", ABBREVIATED),
        "overlap_sentences": of_array(f"(list_transform({sentences(abbreviations('text'))}, lambda y: replace(y, chr(2), '.')))[-{chunking.OVERLAP}:]", ABBREVIATED),
        "adjacent_similarity": adjacent(),
        "cosine_pairs": """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
          m AS (SELECT label, dim, avg(x) AS mean FROM x GROUP BY label, dim), c AS (SELECT label, list(mean ORDER BY dim) AS c FROM m GROUP BY label)
          SELECT vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c.c), 6) AS cosine FROM embeddings e JOIN c ON c.label = e.label""",
        "group_threshold": group_threshold(),
        "merge_small_chunks": chunks(20),
        "chunk_documents": chunks(chunking.MIN_TOKENS),
        "chunk_config": """WITH q AS (SELECT doc_id, length(coalesce(text, '')) * 10 AS n, unnest(['Fast', 'Balanced', 'High Quality', 'other']) AS quality FROM documents),
          b AS (SELECT *, CASE quality WHEN 'Fast' THEN 1000 WHEN 'High Quality' THEN 600 ELSE 800 END AS base FROM q)
          SELECT doc_id, quality, CASE WHEN n > 50000 THEN least(1200, base + 200) ELSE base END AS max_tokens FROM b""",
        "valid_chunks": docs(*chunk_steps(20), "f AS (SELECT doc_id, text FROM k UNION ALL SELECT doc_id, left(text, 8000) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM k))", final=f"SELECT doc_id, count(*) AS n_chunks, sum({valid_chunk('text')}::BIGINT)::BIGINT AS n_valid FROM f GROUP BY doc_id"),
        "detect_book_score": of_text(BOOK, n_words=nt, book_score=f"round({book_score('text')}, 6)", paper_score=f"round({paper_score('text')}, 6)"),
        "detect_paper_score": of_text(PAPER, n_words=nt, book_score=f"round({book_score('text')}, 6)", paper_score=f"round({paper_score('text')}, 6)"),
        "detect_document_type": detected("text"),
        "adaptive_route_books": detected(BOOK),
        "adaptive_route_papers": detected(PAPER),
        "extract_sections": section_rows(),
        "skip_references": section_rows(" WHERE lower(name) <> 'references'"),
        "detect_chapters": docs(*chapter_steps(BOOK), final="SELECT doc_id, pos, number, title, length(t) AS n_chars, md5(t) AS text_md5 FROM ch"),
        "top_chapters": docs(*chapter_steps(BOOK), f"k AS (SELECT * FROM ch WHERE pos < {structure.MAX_CHAPTERS} AND {strip('t')} <> '')", final="SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, number, title, length(t) AS n_chars, md5(t) AS text_md5 FROM k"),
        "extract_title_paper": docs(f"e AS (SELECT doc_id, text, {PAPER} AS p FROM d)", final=f"SELECT doc_id, {paper_title('text')} AS title, {paper_title('p')} AS title_like FROM e"),
        "extract_title_book": docs(f"e AS (SELECT doc_id, text, {BOOK} AS p FROM d)", final=f"SELECT doc_id, {book_title('text')} AS title, {book_title('p')} AS title_like FROM e"),
        "extract_authors": docs(f"e AS (SELECT doc_id, {PAPER} || chr(10) || 'Author: Cy Poe' || chr(10) || 'By: Di Fox' AS text FROM d)", final=f"SELECT doc_id, array_to_string({paper_authors('text')}, '|') AS authors FROM e"),
        "extract_author_book": docs(f"e AS (SELECT doc_id, text, {BOOK} AS p FROM d)", final=f"SELECT doc_id, {book_author('p')} AS author, {book_author('(text || chr(10) || ' + lit('© 2020 Eve Sun') + ')')} AS rights, {book_author('text')} AS unknown FROM e"),
        "format_summaries": layouts(),
        "metric_syllables": of_text(n_syllables=f"coalesce(list_sum(list_transform(regexp_extract_all({plain('text')}, {pat(metrics.WORD)}), lambda v: {syllables('v')})), 0)::BIGINT"),
        "metric_flesch": docs(*flesch_steps(condensed(NOTED), "d", "x"), *flesch_steps("text", "d", "y"), final="SELECT x.doc_id, round(x.v, 6) AS flesch, round(y.v, 6) AS flesch_all FROM x JOIN y USING (doc_id)"),
        "metric_coverage": docs(f"e AS (SELECT doc_id, text, {c} AS sm FROM d)", final=f"SELECT doc_id, round({coverage('text', 'sm')}, 6) AS coverage FROM e"),
        "metric_redundancy": docs(*redundancy_steps("text", "d", "x"), *redundancy_steps("text || ' ' || text", "d", "y"), final="SELECT x.doc_id, round(x.v, 6) AS redundancy, round(y.v, 6) AS redundancy_twice FROM x JOIN y USING (doc_id)"),
        "metric_density": of_text(density=f"round({density('text')}, 6)"),
        "metric_compression": docs(f"e AS (SELECT doc_id, text, {c} AS sm FROM d)", final=f"SELECT doc_id, round({compression('text', 'sm')}, 6) AS compression, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {compression('text', 'sm')} / 5.0::DOUBLE)), 6) AS score FROM e"),
        "metric_length_penalty": docs(f"e AS (SELECT doc_id, text, {c} AS sm FROM d)", final=f"SELECT doc_id, round({penalty('text', 'sm')}, 6) AS penalty FROM e"),
        "evaluate_summaries": evaluated(),
        "adaptive_summaries": adaptive(),
        "chunk_summaries": chunk_summaries(),
        "merge_summaries": merged_summaries(),
        "refine_fold": refined_fold(),
        "pipeline_events": events("SELECT * FROM al"),
        "pipeline_event_counts": events("SELECT type, count(*) AS n FROM al GROUP BY type"),
        "semantic_dedup": whole_greedy(0.3, "label", "g AS label, unnest(ids) AS vec_id"),
        "semantic_dedup_all": whole_greedy(0.3, "0", "unnest(ids) AS vec_id"),
        "passage_dedup": greedy(0.15),
        "pipeline_summaries": final_events(),
        "semantic_chunks": by_meaning(200, 1, 64),
        "page_stream": paged_documents(),
        "centroid_by_label": "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, dim, round(avg(x), 6) AS mean FROM x GROUP BY label, dim",
    }
