"""The queries over these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontaminate, embeddings, licenses, lm, minhash, neighbours, pii, quality, secrets, spelling, token_files
from ._tables import read


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(docs.filter(~lm.held_out(F.col("doc_id"))))
    scored = lm.score(docs, model)
    return scored.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans that base patterns find outlast the added ones, so their digest is over the spans of the plain text."""
    found = pii.scan(read(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"), F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.scored(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = bpe.Tokenizer(spark, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = tokenizer.round_trip(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    names = F.transform("licenses", lambda x: x["name"])
    best = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), best.alias("coverage"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_files.write(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return token_files.read(spark, written).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors.filter(F.col("vec_id") % 100 == 0), neighbours.index(vectors))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted(spelling.occurrences(read(spark, sf_dir, "documents"))))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    repaired = conversations.repair(conversations.damaged(rows))
    found = repaired.report().withColumnRenamed("conv_id", "id")
    hashed = repaired.digests().withColumnRenamed("conv_id", "of")
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    every = ids.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.select("conv_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links (a, b) in both directions, and nodes (id), to the smallest id that each node reaches.
_REACH = """reach(a, b) as (select id, id from nodes union select r.a, l.b from reach r join links l on r.b = l.a),
    least as (select a as id, min(b) as component_id from reach group by a)"""

#: crc32 of a text's UTF-8 bytes, by a table of 256 entries that the rule gives.
_CRC_TABLE = "(select list_transform(range(256), lambda n: list_reduce([n::bigint, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t)"


def _crc(text: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


SQL = {
    "op12_spelling_variants": f"""with recursive crc as {_CRC_TABLE},
    runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
    once as (select id, run, count(*) as k from runs where length(run) >= 6 group by all),
    hashed as (select run, k, {_crc("id || ':' || run")} as h from once, crc),
    words as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(k)::bigint as n from hashed group by 1 having length(word) >= 6 and sum(k) >= 5),
    cut as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest, substr(word, 1, i) || '*' || substr(word, i + 2) as gap from (select *, unnest(range(length(word))) as i from words)),
    pairs as (select a.word as u, b.word as v from cut a join cut b on a.gap = b.gap and a.word <> b.word
        union select c.word, w.word from cut c join words w on c.rest = w.word union select w.word, c.word from cut c join words w on c.rest = w.word),
    ranked as (select u, v, n, count(*) over (partition by u) as n_near, row_number() over (partition by u order by n desc, v) as r from pairs join words on v = word),
    forms as (select words.word, words.n, coalesce(n_near, 0) as n_near, case when ranked.n >= 5 * words.n then v end as form, case when ranked.n >= 5 * words.n then ranked.n end as form_n from words left join ranked on word = u and r = 1),
    chain(word, root, step) as (select word, word, 0 from forms union all select chain.word, form, step + 1 from chain join forms on chain.root = forms.word where form is not null),
    ends as (select word, arg_max(root, step) as root from chain group by word)
    select forms.word, form, root, n, n_near, form_n from forms join ends on forms.word = ends.word""",
    "op13_conversation_repair": f"""with recursive crc as {_CRC_TABLE},
    keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
    hashed as (select conv_id, turn, role, text, {_crc("k")} % 20 as h from keyed, crc),
    harmed as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when h = 3 then 2 else 1 end)) as copy from hashed where h <> 0),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from harmed),
    judged as (select *, case when body = '' then 'b' when nth > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault, lag(substr(role, 1, 1)) over (partition by conv_id order by i) as prior from placed),
    counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
        count(*) filter (i > 1 and prior || substr(role, 1, 1) not in ('su', 'ua', 'au')) as illegal, max(i) as n from judged group by conv_id),
    step(a, b, x) as (values (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
    closure(a, b, cost, audit) as (select s, s, 0, '' from range(4) r(s) union all select closure.a, step.b, cost + 3, audit || 'I' from closure join step on closure.b = step.a where x <> 's' and length(audit) < 3),
    edits as (select x as initial, a, b, 0 as cost, 'K' as edit from step union all select y, a, b, 3, 'R' from step, (values ('s'), ('u'), ('a'), ('x')) o(y) where x <> 's' union all select y, s, s, 4, 'D' from range(4) r(s), (values ('s'), ('u'), ('a'), ('x')) o(y)),
    best(conv_id, i, state, way) as (
        select conv_id, 0, b, {{'cost': cost, 'audit': audit}} from counted, closure where a = 0
        union all select p.conv_id, p.i + 1, c.b, min({{'cost': p.way.cost + e.cost + c.cost + case when j.fault = 't' and e.edit <> 'D' then 3 else 0 end, 'audit': p.way.audit || e.edit || c.audit}})
        from best p join judged j on j.conv_id is not distinct from p.conv_id and j.i = p.i + 1
        join edits e on e.a = p.state and e.initial = case when substr(role, 1, 1) in ('s', 'u', 'a') then substr(role, 1, 1) else 'x' end and (e.edit = 'D' or j.fault not in ('b', 'd'))
        join closure c on c.a = e.b group by p.conv_id, p.i + 1, c.b),
    chosen as (select c.conv_id, min(way) as way from best b join counted c on c.conv_id is not distinct from b.conv_id and b.i = c.n where state in (0, 3) group by c.conv_id),
    marks as (select conv_id, pos, substr(way.audit, pos, 1) as edit from (select *, unnest(range(1, length(way.audit) + 1)) as pos from chosen)),
    rows_of as (select *, count(*) filter (edit <> 'I') over (partition by conv_id order by pos) as i from marks),
    kept as (select r.conv_id, r.pos, r.edit, j.role, case when r.edit = 'I' then '' else j.text end as text, row_number() over (partition by r.conv_id order by r.pos) as k, count(*) over (partition by r.conv_id) as m
        from rows_of r left join judged j on j.conv_id is not distinct from r.conv_id and j.i = r.i where r.edit <> 'D'),
    told as (select conv_id, sha256(string_agg(case when edit = 'K' then role when (k + m) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by k)) as digest from kept group by conv_id)
    select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(way.cost, 0)::bigint as cost, coalesce(way.audit, '') as audit, coalesce(digest, sha256('')) as repaired_sha256
    from (select distinct conv_id from conversations) o left join counted c on c.conv_id is not distinct from o.conv_id left join chosen h on h.conv_id is not distinct from o.conv_id left join told t on t.conv_id is not distinct from o.conv_id""",
    "op2_embedding_dedup": f"""with recursive
    v as (select vec_id, label, embedding::double[] as x from embeddings where label is not null and embedding is not null and list_max(list_transform(embedding, lambda y: abs(y))) > 0),
    links(a, b) as (select p.vec_id, q.vec_id from v p join v q on p.label = q.label and p.vec_id <> q.vec_id where list_cosine_similarity(p.x, q.x) >= 0.98),
    nodes as (select distinct vec_id as id from embeddings), {_REACH}
    select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
    from embeddings join least on vec_id = id left join (select a, count(*) as n from links group by a) on vec_id = a""",
    "op7_decontamination": f"""with
    dw as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
    iw as (select item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
    win as (select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[i + 1:i + 10], ' ') as w from (select *, unnest(range(0, greatest(len(ws) - 9, 1))) as i from iw where len(ws) > 0)),
    cut as (select doc_id, n, i, array_to_string(ws[i + 1:i + n], ' ') as w from (select *, unnest(range(0, len(ws) - n + 1)) as i from dw, (select distinct n from win) where len(ws) >= n)),
    hit as (select doc_id, item_id, i, cut.n from cut join win on cut.w = win.w and cut.n = win.n),
    words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
    items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as all_items from (select distinct doc_id, coalesce(item_id::varchar, '') as item from hit) group by doc_id)
    select dw.doc_id, coalesce(len(ws), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(all_items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from dw left join words on dw.doc_id = words.doc_id left join items on dw.doc_id = items.doc_id""",
    "op10_minhash_dedup": f"""with recursive
    dw as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) as ws from documents),
    sh as (select distinct doc_id, array_to_string(ws[i + 1:i + least(5, len(ws))], ' ') as s from (select *, unnest(range(0, greatest(len(ws) - 4, 1))) as i from dw where len(ws) > 0)),
    sized as (select doc_id, count(*) as n from sh group by doc_id),
    common as (select p.doc_id as a, q.doc_id as b, count(*) as k from sh p join sh q on p.s = q.s and p.doc_id <> q.doc_id group by all),
    links(a, b) as (select a, b from common join sized x on a = x.doc_id join sized y on b = y.doc_id where 100 * k >= 85 * (x.n + y.n - k)),
    nodes as (select distinct doc_id as id from documents), {_REACH}
    select documents.doc_id, coalesce(n, 0) as n_shingles, component_id, documents.doc_id = component_id as kept
    from documents join least on documents.doc_id = id left join sized on documents.doc_id = sized.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """For the operators whose results SQL can express; the others are tested against plain versions."""
    return SQL
