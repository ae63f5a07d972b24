"""The registered queries of the text operators: each applies its operator to a whole table and returns the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import bpe, byte_bpe, fp_search, licences, lm, mixing, near_dups, neighbours, pii, prefix_trie, quality, secrets, token_counts
from pointloom.llm.common import documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    count = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", *(count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)), F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
        pii.span_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(documents(spark, sf_dir))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("found.family"))), ",")
    return found.select("doc_id", "n_candidates", F.size("found").cast("long").alias("n_paragraphs"), names.alias("families"), F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["line"], x["family"])), ",").alias("lines"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    count = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    text = lambda spans: pii.span_text(spans, secrets.KINDS)
    return found.select(
        "doc_id", *(count(i).alias(f"n_{kind}") for i, kind in enumerate(secrets.KINDS)), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.array_sort(F.concat("base", "added"))).alias("spans")
    )


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir), width=2)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.trie(prefix_trie.sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"), family=20))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("item_id", "rank", "doc_id", "score")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode_decode(documents(spark, sf_dir), *vocabulary)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_personal_data, op3_quality_rules, op4_lm_score, op5_licences, op6_nearest, op7_token_counts, op8_secrets, op9_near_dups, op10_bpe, op11_prefix_trie, op12_lexical_search, op13_byte_bpe)}
#: Targets by the level at which sources run full, documents in the order of their hash, positions by the inverse of each
#: slot's one straight piece.
MIX_SQL = r"""with d as (select doc_id, source, coalesce('=' || source, '') skey, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size, md5('17|' || coalesce(cast(doc_id as varchar), '')) h from documents),
    s as (select skey, source, cast(sum(size) as bigint) source_size from d group by 1, 2), w as (select *, (row_number() over (order by source nulls last) - 1) % 3 slot from s),
    f as (select *, case slot when 0 then 5e0 when 1 then 2e0 else 1e0 end weight, 3e0 * source_size cap from w), g as (select *, cap / weight fill from f),
    l as (select *, (cast(sum(source_size) over () as double) - coalesce(sum(cap) over (order by fill, skey rows between unbounded preceding and 1 preceding), 0))
        / (sum(weight) over () - coalesce(sum(weight) over (order by fill, skey rows between unbounded preceding and 1 preceding), 0)) level from g),
    k as (select (select level from l where level <= fill order by fill, skey limit 1) level), t as (select l.skey, source_size, slot, coalesce(least(cap, weight * k.level), cap) target from l, k),
    o as (select doc_id, size, source_size, slot, target, cast(round(target) as bigint) goal, cast(coalesce(sum(size) over (partition by d.skey order by h, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) ahead from d join t on t.skey = d.skey),
    p as (select *, greatest(0, least(size, goal - ahead)) a, greatest(0, least(size, goal - source_size - ahead)) b, greatest(0, least(size, goal - 2 * source_size - ahead)) c,
        case slot when 0 then 1.5e0 when 1 then 1e0 else 0.5e0 end r0, case slot when 0 then -1e0 when 1 then 0e0 else 1e0 end slope, cast(ahead as double) / greatest(goal, 1) need from o)
    select doc_id, size, source_size, target, cast(a + b + c as bigint) taken,
        case when a > 0 then round(least(case when need <= 0 then 0e0 else 2 * need / (r0 + sqrt(greatest(r0 * r0 + 2 * slope * need, 0))) end, 1), 9) end position from p"""
#: Every pair of documents that shares a shingle, and all that links lead to.
NEAR_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
    s as (select doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) = 1 then w else list_distinct([w[i] || ' ' || w[i+1] for i in range(1, len(w))]) end s from w),
    n as (select doc_id, cast(len(s) as bigint) n from s), e as (select doc_id, hash(x) x from (select doc_id, unnest(s) x from s) q),
    p as (select a.doc_id a, b.doc_id b, count(*) k from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
    l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 80 * (na.n + nb.n - k)), t as (select a, b from l union all select b, a from l),
    r as (select doc_id, doc_id c from n union select r.doc_id, t.b from r join t on r.c = t.a), m as (select doc_id, min(c) component_id from r group by 1)
    select n.doc_id, n.n n_shingles, m.component_id, n.doc_id = m.component_id kept from n join m on m.doc_id = n.doc_id"""
#: Every prefix of every rebuilt conversation as a row; subtrees by the prefixes of each node's least member. CRC-32 bit by bit.
TRIE_SQL = r"""with t as (select conv_id c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) w from conversations where conv_id is not null),
    s as (select c, list(id order by turn nulls first, id) ids, list(w order by turn nulls first, id) ws from t group by c),
    h as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384::bigint))), 4294967295::bigint) % 4 h from s),
    r as (select h.c, coalesce(b.ids[1:h], []) || h.ids[h+1:] ids, coalesce(b.ws[1:h], []) || h.ws[h+1:] ws from h left join s b on b.c = h.c - h.c % 20),
    p as (select c, d, array_to_string(ids[1:d], '') k, array_to_string(ids[1:d-1], '') up, case when d > 0 then ws[d] else 0 end w, len(ids) n from (select *, unnest(range(len(ids) + 1)) d from r)),
    n as (select d, k, any_value(up) up, min(c) c, count(*) n, any_value(w) w, coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '') ends from p group by d, k),
    k as (select d - 1 d, up k, count(*) kids from n where d > 0 group by 1, 2), x as (select n.*, coalesce(kids, 0) kids from n left join k using (d, k)),
    u as (select p.d, p.k, sum((x.kids = 0)::int) leaves, sum((x.n - 1) * x.w) saved from x join p on p.c = x.c and p.d <= x.d group by 1, 2)
    select x.c conv_id, x.d depth, y.c parent_conv_id, x.n n_convs, x.kids n_children, leaves::bigint n_leaves, saved::bigint saved_tokens, sha256(x.ends) ends_sha256
    from x join u using (d, k) left join x y on y.d = x.d - 1 and y.k = x.up and x.d > 0"""
#: Every document that holds a term of an item.
SEARCH_SQL = r"""with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents),
    i as (select row_number() over () i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from benchmark),
    q as (select i, item_id, t, count(*) q from (select i, item_id, unnest(t) t from i) group by all), a as (select count(*)::bigint n, sum(len(t))::bigint l from d where len(t) > 0),
    f as (select r, t, count(*) tf from (select r, unnest(t) t from d) where t in (select t from q) group by all), w as (select t, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)))::bigint w from f, a group by t, n),
    m as (select r, doc_id, 100 - 75 + (75 * len(t) * n) // l m from d, a where len(t) > 0),
    s as (select i, item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from q join f using (t) join w using (t) join m using (r) group by i, item_id, r, doc_id)
    select item_id, rank::int rank, doc_id, score from (select *, row_number() over (partition by i order by score desc, doc_id nulls last) rank from s where score > 0) where rank <= 10"""
#: The other queries return learned models' results, hashes of tokens or positions of pattern matches.
ORACLES: dict[str, str] = {"op1_mix_sources": MIX_SQL, "op9_near_dups": NEAR_SQL, "op11_prefix_trie": TRIE_SQL, "op12_lexical_search": SEARCH_SQL}
