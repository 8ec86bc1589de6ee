"""Occurrence queries, up to the flagship extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import base, mart, view
from catalog.registry import in_order, query, r6, scratch
from catalog.sources import with_rings
from phylomart.functions.geo import haversine_km
from phylomart.operators import occurrences as o
from phylomart.operators.hierarchy import with_subspecies
from phylomart.plans.occurrences import build_occurrences, extract_occurrences
from phylomart.sources.tabular import write_species_csv, write_tsv, written_species
from phylomart.streaming.occurrences import stored_schema, stream_occurrences

# records of every species through any of its variants
RECORDS = """select x.taxon_name, o.* from fx_occurrences o join fx_taxonvariants v on o.taxonvariant_id = v.taxonvariant_id
join fx_taxa x on v.taxon_id = x.taxon_id where x.taxon_level = 'SPECIES'"""


def records(spark, sf):
    tables = mart(spark, sf)
    species = tables["taxa"].filter("taxon_level = 'SPECIES'").select("taxon_id", "taxon_name")
    owned = tables["taxonvariants"].join(species, "taxon_id").select("taxonvariant_id", "taxon_name")
    return tables["occurrences"].join(owned, "taxonvariant_id")


def dist(a: str, b: str) -> str:
    """Haversine in SQL."""
    lat = f"power(sin(radians({b}.decimal_latitude - {a}.decimal_latitude) / 2), 2)"
    lon = f"power(sin(radians({b}.decimal_longitude - {a}.decimal_longitude) / 2), 2)"
    return f"2 * 6371.0 * asin(least(1.0, sqrt({lat} + cos(radians({a}.decimal_latitude)) * cos(radians({b}.decimal_latitude)) * {lon})))"


@query("d1_distinct_labels", "select label, row_number() over (order by label) as position from (select distinct label from fx_occ_raw) t")
def _(spark, sf):
    return in_order(o.distinct_labels(view(spark, sf, "fx_occ_raw")))


@query("d2_distinct_coordinates", f"""select taxon_name, decimal_latitude, decimal_longitude, min(occurrence_id) as occurrence_id, arg_min(basis_of_record, occurrence_id) as basis_of_record
from ({RECORDS}) r group by taxon_name, decimal_latitude, decimal_longitude""")
def _(spark, sf):
    kept = o.distinct_coordinates(records(spark, sf))
    return kept.select("taxon_name", "decimal_latitude", "decimal_longitude", "occurrence_id", "basis_of_record")


PAIRS = f"""select a.taxon_name, a.occurrence_id, count(b.occurrence_id) as partners, sum(case when b.occurrence_id is not null then {dist('a', 'b')} end) as total_km,
  avg(case when b.occurrence_id is not null then {dist('a', 'b')} end) as mean_km from ({RECORDS}) a left join ({RECORDS}) b on a.taxon_name = b.taxon_name and a.occurrence_id <> b.occurrence_id group by a.taxon_name, a.occurrence_id"""


@query("c12_pairwise_within_group", f"""select occurrence_id, taxon_name, partners, round(coalesce(total_km, 0), 4) as total_km, round(mean_km, 5) as mean_km from ({PAIRS}) p""")
def _(spark, sf):
    rows = o.pairwise_within_group(records(spark, sf))
    return rows.select("occurrence_id", "taxon_name", "partners", F.round("total_km", 4).alias("total_km"), F.round("mean_km", 5).alias("mean_km"))


@query("d5_filter_outliers", f"""with means as ({PAIRS}), spread as (select taxon_name, avg(mean_km) as centre, stddev_samp(mean_km) as sd from means group by taxon_name)
select m.occurrence_id, m.taxon_name from means m join spread s on m.taxon_name = s.taxon_name where m.mean_km is null or abs(m.mean_km - s.centre) <= s.sd + 1e-9""")
def _(spark, sf):
    return o.filter_outliers(records(spark, sf), thresh=1.0).select("occurrence_id", "taxon_name")


@query("d6_min_records_gate", f"select occurrence_id, taxon_name from ({RECORDS}) r where taxon_name in (select taxon_name from ({RECORDS}) q group by taxon_name having count(*) >= 6)")
def _(spark, sf):
    return o.min_records_gate(records(spark, sf), n=6).select("occurrence_id", "taxon_name")


@query("d7_latitude_summary", f"""select taxon_name, round(avg(abs(decimal_latitude)), 6) as average_absolute_latitude, round(max(decimal_latitude) - min(decimal_latitude), 6) as latitudinal_range
from ({RECORDS}) r group by taxon_name""")
def _(spark, sf):
    rows = o.latitude_summary(records(spark, sf))
    return rows.select("taxon_name", r6("average_absolute_latitude").alias("average_absolute_latitude"), r6("latitudinal_range").alias("latitudinal_range"))


@query("f1_haversine_km", f"""with centre as (select taxon_name, avg(decimal_latitude) as decimal_latitude, avg(decimal_longitude) as decimal_longitude from ({RECORDS}) r group by taxon_name)
select a.occurrence_id, round({dist('a', 'c')}, 6) as km from ({RECORDS}) a join centre c on a.taxon_name = c.taxon_name""")
def _(spark, sf):
    rows = records(spark, sf)
    centre = rows.groupBy("taxon_name").agg(F.avg("decimal_latitude").alias("lat"), F.avg("decimal_longitude").alias("lon"))
    km = haversine_km(F.col("decimal_latitude"), F.col("decimal_longitude"), F.col("lat"), F.col("lon"))
    return rows.join(centre, "taxon_name").select("occurrence_id", r6(km).alias("km"))


@query("f2_sample_n", f"""select taxon_name, occurrence_id from (select taxon_name, occurrence_id, row_number() over (partition by taxon_name order by md5(concat('7:', cast(occurrence_id as string))), occurrence_id) as rn
from ({RECORDS}) r) s where rn <= 4""")
def _(spark, sf):
    return o.sample_n(records(spark, sf), n=4, seed=7).select("taxon_name", "occurrence_id")


IN_RING = """((p.decimal_longitude > g.x0 and p.decimal_longitude < g.x1 and p.decimal_latitude > g.y0 and p.decimal_latitude < g.y1)
  and (g.hx0 is null or not (p.decimal_longitude > g.hx0 and p.decimal_longitude < g.hx1 and p.decimal_latitude > g.hy0 and p.decimal_latitude < g.hy1)))"""


def by_range(source: str, out: str, least: int) -> str:
    """SQL of the range rule over ``source`` as tables ``{out}_hits`` and ``{out}``."""
    return f"""{out}_hits as (select distinct p.taxon_name, p.occurrence_id from {source} p join names m on m.taxon_name = p.taxon_name
  join fx_ranges g on g.binomial = m.name and g.legend <> 'Reintroduced' and {IN_RING}),
{out}_enough as (select taxon_name from {out}_hits group by taxon_name having count(*) >= {least}),
{out} as (select p.* from {source} p where p.taxon_name not in (select taxon_name from {out}_enough) or p.occurrence_id in (select occurrence_id from {out}_hits))"""


OWN_NAMES = """names as (select x.taxon_name, v.taxonvariant_name as name from fx_taxonvariants v join fx_taxa x on v.taxon_id = x.taxon_id where x.taxon_level = 'SPECIES')"""


@query("c11_filter_by_range", f"""with {OWN_NAMES}, records as ({RECORDS}), {by_range('records', 'ranged', 3)} select taxon_name, occurrence_id from ranged""")
def _(spark, sf):
    tables = mart(spark, sf)
    species = tables["taxa"].filter("taxon_level = 'SPECIES'").select("taxon_id", "taxon_name")
    names = tables["taxonvariants"].join(species, "taxon_id").select("taxon_name", F.col("taxonvariant_name").alias("name"))
    ranges = with_rings(view(spark, sf, "fx_ranges"))
    placed = records(spark, sf).select("taxon_name", "occurrence_id", "decimal_latitude", "decimal_longitude")
    return o.filter_by_range(placed, ranges, names, 3).select("taxon_name", "occurrence_id")


WITH_SUBSPECIES = """select s.node_id as taxon_id, v.taxonvariant_id, v.taxonvariant_name from fx_taxonomy s join fx_taxonvariants v on v.taxon_id = s.node_id where s.lvl = 'SPECIES'
union select c.parent_id, v.taxonvariant_id, v.taxonvariant_name from fx_taxonomy c join fx_taxonvariants v on v.taxon_id = c.node_id join fx_taxonomy s on s.node_id = c.parent_id where s.lvl = 'SPECIES'"""


@query("e2_with_subspecies", WITH_SUBSPECIES)
def _(spark, sf):
    tables = mart(spark, sf)
    species = tables["taxa"].filter("taxon_level = 'SPECIES'")
    return with_subspecies(species, tables["branches"], tables["taxonvariants"])


CLEAN = """select distinct gbif_id, event_date, cast(decimal_latitude as double) as decimal_latitude, cast(decimal_longitude as double) as decimal_longitude, decimal_latitude as latitude_text, label, basis_of_record
from fx_occ_raw where decimal_latitude not in ('', '0') and decimal_longitude not in ('', '0') and event_date <> '' and has_geospatial_issues = 'false' and basis_of_record <> 'UNKNOWN'"""


@query("g4_build_occurrences", f"""with clean as ({CLEAN}), fresh as (select * from clean where basis_of_record <> 'FOSSIL_SPECIMEN'),
known as (select l.completename as label, coalesce(o.taxonvariant_id, c.taxonvariant_id) as vid from fx_longnames l left join fx_synonym_links k on k.tsn = l.tsn join fx_longnames a on a.tsn = coalesce(k.tsn_accepted, l.tsn)
  left join fx_taxonvariants o on o.taxonvariant_name = l.completename left join fx_taxonvariants c on c.taxonvariant_name = a.completename)
select (select max(occurrence_id) from fx_occurrences where basis_of_record = 'FOSSIL_SPECIMEN') + row_number() over (order by gbif_id) as occurrence_id,
  f.gbif_id, f.decimal_latitude, f.decimal_longitude, f.latitude_text, f.label, k.vid as taxonvariant_id from fresh f left join known k on k.label = f.label""")
def _(spark, sf):
    tables = mart(spark, sf)
    tables["occurrences"] = tables["occurrences"].filter("basis_of_record = 'FOSSIL_SPECIMEN'")
    built = build_occurrences(view(spark, sf, "fx_occ_raw"), tables).occurrences
    return built.select("occurrence_id", "gbif_id", "decimal_latitude", "decimal_longitude", "latitude_text", "label", "taxonvariant_id")


def flagship_sql(occurrences: str, sample: int, least: int) -> str:
    """The extraction over ``occurrences``, with the size of the sample and the records a species needs."""
    return f"""with names as (select distinct x.taxon_name, w.taxonvariant_id, w.taxonvariant_name as name from ({WITH_SUBSPECIES}) w join fx_taxa x on x.taxon_id = w.taxon_id),
fetched as (select n.taxon_name, o.* from {occurrences} o join names n on o.taxonvariant_id = n.taxonvariant_id),
sampled as (select * from (select *, row_number() over (partition by taxon_name order by md5(concat('0:', cast(occurrence_id as string))), occurrence_id) as rn from fetched) s where rn <= {sample}),
kept as (select * from sampled where basis_of_record in ('PRESERVED_SPECIMEN', 'HUMAN_OBSERVATION', 'FOSSIL_SPECIMEN', 'OBSERVATION')
  and length(replace(substring(event_date, 1, 10), '-', '')) = 8 and try_cast(replace(substring(event_date, 1, 10), '-', '') as integer) >= 19960101
  and length(split_part(latitude_text, '.', 2)) >= 2 and length(split_part(longitude_text, '.', 2)) >= 2),
places as (select * from (select *, row_number() over (partition by taxon_name, decimal_latitude, decimal_longitude order by occurrence_id) as nth from kept) k where nth = 1),
gated as (select * from places where taxon_name in (select taxon_name from places group by taxon_name having count(*) >= {least})),
{by_range('gated', 'ranged', least)},
gated2 as (select * from ranged where taxon_name in (select taxon_name from ranged group by taxon_name having count(*) >= {least})),
means as (select a.taxon_name, a.occurrence_id, avg({dist('a', 'b')}) as mean_km from gated2 a join gated2 b on a.taxon_name = b.taxon_name and a.occurrence_id <> b.occurrence_id group by a.taxon_name, a.occurrence_id),
spread as (select taxon_name, avg(mean_km) as centre, stddev_samp(mean_km) as sd from means group by taxon_name),
near as (select m.occurrence_id from means m join spread s on m.taxon_name = s.taxon_name where abs(m.mean_km - s.centre) <= s.sd * 1.5 + 1e-9),
final as (select * from gated2 where occurrence_id in (select occurrence_id from near))
select gbif_id, taxon_name, decimal_latitude, decimal_longitude from final where taxon_name in (select taxon_name from final group by taxon_name having count(*) >= {least})"""


FLAGSHIP = flagship_sql("fx_occurrences", 12, 3)


@query("g7_extract_occurrences", FLAGSHIP)
def flagship(spark, sf):
    tables = mart(spark, sf)
    roots = tables["taxa"].filter("taxon_level = 'ORDER'").select(F.col("taxon_name").alias("label"))
    kept = extract_occurrences(
        tables, roots, with_rings(view(spark, sf, "fx_ranges")), sample=12, mindate="1996-01-01", min_records=3, min_in_range=3, thresh=1.5
    )
    return kept.select("gbif_id", "taxon_name", "decimal_latitude", "decimal_longitude")


# at the default sample and gates; only the outlier rule, which is off by default, is set
@query("g7_extract_full_sample", flagship_sql("fx_lumped_occurrences", 1000, 10))
def _(spark, sf):
    tables = {**mart(spark, sf), "occurrences": view(spark, sf, "fx_lumped_occurrences")}
    roots = tables["taxa"].filter("taxon_level = 'ORDER'").select(F.col("taxon_name").alias("label"))
    kept = extract_occurrences(tables, roots, with_rings(view(spark, sf, "fx_ranges")), mindate="1996-01-01", thresh=1.5)
    return kept.select("gbif_id", "taxon_name", "decimal_latitude", "decimal_longitude")


# a first run wrote the species of debtors; the second leaves out those that have files
@query("g7_resume", f"select * from ({FLAGSHIP}) f where taxon_name not in (select c_name from customer where c_acctbal < 0)")
def _(spark, sf):
    folder, tables = f"{scratch(spark)}/species", mart(spark, sf)
    orders = tables["taxa"].filter("taxon_level = 'ORDER'").select(F.col("taxon_name").alias("label"))
    debtors = base(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_name").alias("label"))
    settings = {"sample": 12, "mindate": "1996-01-01", "min_records": 3, "min_in_range": 3, "thresh": 1.5}
    ranges = with_rings(view(spark, sf, "fx_ranges"))
    write_species_csv(extract_occurrences(tables, debtors, ranges, **settings), folder)
    kept = extract_occurrences(tables, orders, ranges, finished=written_species(spark, folder), **settings)
    return kept.select("gbif_id", "taxon_name", "decimal_latitude", "decimal_longitude")


RAW_SCHEMA = "gbif_id string, occurrence_type string, basis_of_record string, event_date string, decimal_latitude string, decimal_longitude string, dataset_key string, has_geospatial_issues string, label string"


@query("st1_stream_occurrences", f"select gbif_id, event_date, latitude_text, decimal_longitude, label, basis_of_record from ({CLEAN}) c")
def _(spark, sf):
    folder = scratch(spark)
    raw = view(spark, sf, "fx_occ_raw").drop("taxon_key")
    write_tsv(raw.filter("basis_of_record <> 'FOSSIL_SPECIMEN'"), f"{folder}/in")
    stream_occurrences(spark, f"{folder}/in", f"{folder}/table", f"{folder}/ckpt", RAW_SCHEMA).awaitTermination()
    # the second delivery overlaps the first and then comes a third time
    for _ in range(2):
        write_tsv(raw.filter("basis_of_record <> 'OBSERVATION'"), f"{folder}/in", mode="append")
        stream_occurrences(spark, f"{folder}/in", f"{folder}/table", f"{folder}/ckpt", RAW_SCHEMA).awaitTermination()
    stored = spark.read.schema(stored_schema()).parquet(f"{folder}/table")
    return stored.select("gbif_id", "event_date", "latitude_text", "decimal_longitude", "label", "basis_of_record")
