"""Genotyping by sequencing: barcodes, tags, their SNPs, and samples' alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.alignments import read_alleles, read_variants
from seqloom.operators.calling import call_genotypes
from seqloom.operators.nearest_tags import CHUNK, TAG_LENGTH, match_tags
from seqloom.plans.session import join_sized

MIN_READS, MIN_ALT_READS, MIN_MAPQ = 3, 10, 30
MOST_SPAN, MOST_DIVERGENCE, MOST_RETRIEVED = 1000, 7, 3


def demultiplex(pairs: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Read pairs with the one taxon whose barcodes, the longest that fit, begin both reads; others are dropped.

    ``barcodes`` (taxon, barcode_r1, barcode_r2) is a sample sheet,
    broadcast behind a count; reads meet it by equality for each length of barcodes.
    """
    out = pairs
    for end in ("r1", "r2"):
        sheet = barcodes.groupBy(f"barcode_{end}").agg(F.collect_set("taxon").alias(f"taxa_{end}"))
        lengths = sorted((r[0] for r in sheet.select(F.length(f"barcode_{end}")).distinct().collect()), reverse=True)
        found: Column = F.lit(None).cast(f"struct<barcode_{end}:string,taxa_{end}:array<string>>")
        for n in lengths:
            part = sheet.where(F.length(f"barcode_{end}") == n).select(F.col(f"barcode_{end}").alias("__code"), F.struct("*").alias(f"__{end}_{n}"))
            out = join_sized(out.withColumn("__code", F.substring(f"seq_{end}", 1, n)), part, ["__code"]).drop("__code")
        found = F.coalesce(*[F.col(f"__{end}_{n}") for n in lengths])
        out = out.withColumn(f"__{end}", found).drop(*[f"__{end}_{n}" for n in lengths])
    shared = F.array_intersect("__r1.taxa_r1", "__r2.taxa_r2")
    return out.where(F.size(shared) == 1).select(
        *pairs.columns, shared[0].alias("taxon"), F.col("__r1.barcode_r1").alias("barcode_r1"), F.col("__r2.barcode_r2").alias("barcode_r2")
    )


def trim_reads(pairs: DataFrame, cutter_1: str, cutter_2: str, least: int = CHUNK) -> DataFrame:
    """Both reads without their barcode, cut where either cutter first occurs, to TAG_LENGTH; pairs with N or a short end are dropped."""

    def trimmed(end: str) -> Column:
        body = F.substring(f"seq_{end}", F.length(f"barcode_{end}") + 1, F.lit(1 << 20))
        stops = [F.when(F.instr(body, c) > 0, F.instr(body, c) - 1) for c in (cutter_1, cutter_2)]
        return F.substring(body, F.lit(1), F.least(*stops, F.length(body), F.lit(TAG_LENGTH)))

    rows = pairs.withColumn("tag_r1", trimmed("r1")).withColumn("tag_r2", trimmed("r2"))
    good = (F.length("tag_r1") >= least) & (F.length("tag_r2") >= least) & ~F.contains("tag_r1", F.lit("N")) & ~F.contains("tag_r2", F.lit("N"))
    return rows.where(good)


def make_tags(pairs: DataFrame) -> DataFrame:
    """Trimmed reads padded with A to TAG_LENGTH, with their lengths."""
    return pairs.withColumns({"r1_len": F.length("tag_r1"), "r2_len": F.length("tag_r2"), "tag_r1": F.rpad("tag_r1", TAG_LENGTH, "A"), "tag_r2": F.rpad("tag_r2", TAG_LENGTH, "A")})


def collapse_tags(tags: DataFrame, min_count: int = MIN_READS, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal tags as one with the sum of their reads, ``min_count`` or more; lengths are those of the tag with the smallest lengths."""
    return (
        tags.groupBy(*by, "tag_r1", "tag_r2")
        .agg(F.sum("read_count").alias("read_count"), F.min(F.struct("r1_len", "r2_len")).alias("l"))
        .where(F.col("read_count") >= min_count)
        .select(*by, "tag_r1", "tag_r2", "l.r1_len", "l.r2_len", "read_count")
    )


def tag_totals(tags: DataFrame) -> DataFrame:
    """Number of tags and of reads, and the most tags with the same bases 9 to 14 of R1."""
    groups = tags.groupBy(F.substring("tag_r1", 9, 6).alias("g")).agg(F.count("*").alias("n"), F.sum("read_count").alias("reads"))
    return groups.agg(F.sum("n").alias("n_tags"), F.sum("reads").alias("n_reads"), F.max("n").alias("largest_group"))


def tags_fastq(tags: DataFrame) -> DataFrame:
    """Reads (id, end, seq, qual) of tags for an aligner; the id holds the tag's id and its reads."""
    name = F.concat_ws("_", F.sha2(F.concat("tag_r1", "tag_r2"), 256).substr(1, 16), "read_count")
    ends = F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.substring(f"tag_r{e}", F.lit(1), F.col(f"r{e}_len")).alias("seq")) for e in (1, 2)]))
    return tags.select(name.alias("id"), ends.alias("e")).select("id", "e.end", "e.seq", F.repeat(F.lit("f"), F.length("e.seq")).alias("qual"))


def tag_snps(alignments: DataFrame, min_mapq: int = MIN_MAPQ, most: int = MOST_DIVERGENCE, span: int = MOST_SPAN) -> DataFrame:
    """(query, chrom, pos, ref, alt) of tags whose two ends lie on one chromosome within ``span`` and differ in 1 to ``most`` places.

    Records with a flag over 2000 are left out.
    """
    rows = alignments.where("flag <= 2000")
    ends = rows.where((F.col("cigar") != "*") & (F.col("mapq") >= min_mapq)).groupBy("query").agg(
        F.count("*").alias("n"), F.count_distinct("chrom").alias("chroms"), (F.max("start_pos") - F.min("start_pos")).alias("span")
    )
    good = ends.where((F.col("n") == 2) & (F.col("chroms") == 1) & (F.col("span") < span)).select("query")
    found = read_variants(rows.join(good, "query", "left_semi"), min_mapq).distinct()
    few = found.groupBy("query").count().where(F.col("count").between(1, most)).select("query")
    return found.join(few, "query", "left_semi")


def snp_counts(snps: DataFrame, tags: DataFrame) -> DataFrame:
    """SNP catalogue: reads, tags and alternatives in order of each (chrom, pos)."""
    return snps.join(tags.select("query", "read_count"), "query").groupBy("chrom", "pos", "ref").agg(
        F.sum("read_count").alias("reads"), F.count("*").alias("tags"), F.array_join(F.array_sort(F.collect_set("alt")), ",").alias("alts")
    )


def filter_snps(catalogue: DataFrame, min_reads: int = MIN_ALT_READS) -> DataFrame:
    return catalogue.where(F.col("reads") >= min_reads)


def select_snps(catalogue: DataFrame, positions: DataFrame) -> DataFrame:
    """What lies at validated positions (chrom, pos): of a catalogue, of tag SNPs or of tag alleles."""
    return catalogue.join(positions.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")


def snp_totals(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("chrom").agg(F.count("*").alias("n_snps"), F.sum("reads").alias("reads"))


def tag_alleles(alignments: DataFrame, catalogue: DataFrame, min_mapq: int = MIN_MAPQ, span: int = MOST_SPAN) -> DataFrame:
    """Alleles of tags at catalogue SNPs, by the pair rule of :func:`tag_snps`: (query, chrom, pos, allele, base, read_pos)."""
    rows = alignments.where("flag <= 2000")
    ends = rows.where((F.col("cigar") != "*") & (F.col("mapq") >= min_mapq)).groupBy("query").agg(
        F.count("*").alias("n"), F.count_distinct("chrom").alias("chroms"), (F.max("start_pos") - F.min("start_pos")).alias("span")
    )
    good = ends.where((F.col("n") == 2) & (F.col("chroms") == 1) & (F.col("span") < span)).select("query")
    return read_alleles(rows.join(good, "query", "left_semi"), catalogue.select("chrom", "pos", "ref", "alts"), min_mapq)


def choose_match(matches: DataFrame, query: DataFrame, alleles: DataFrame) -> DataFrame:
    """Of each query's nearest library tags the first, by id, whose recorded allele bases (end, read_pos, base) the query has."""
    seen = alleles.groupBy("library_id").agg(F.collect_list(F.struct("end", "read_pos", "base")).alias("alleles"))
    rows = matches.join(seen, "library_id", "left").join(query.select(F.col("id").alias("query_id"), "tag_r1", "tag_r2"), "query_id")
    agree = F.forall("alleles", lambda x: F.substring(F.when(x["end"] == 1, F.col("tag_r1")).otherwise(F.col("tag_r2")), x["read_pos"], F.lit(1)) == x["base"])
    return rows.where(F.coalesce(agree, F.lit(True))).groupBy("query_id").agg(F.min("library_id").alias("library_id"))


def sample_allele_depth(samples: DataFrame, alleles: DataFrame) -> DataFrame:
    """Reads of each sample, SNP and allele from its matched tags (sample, library_id, read_count)."""
    rows = samples.join(alleles.select("library_id", "chrom", "pos", "allele"), "library_id")
    return rows.groupBy("sample", "chrom", "pos", "allele").agg(F.sum("read_count").cast("bigint").alias("depth"))


def site_alleles(depth: DataFrame, catalogue: DataFrame, most: int = 2) -> DataFrame:
    """The alternative alleles of a site by total depth, then base, at most ``most``; sites without any are left out."""
    sums = depth.groupBy("chrom", "pos", "allele").agg(F.sum("depth").alias("total"))
    alts = sums.join(catalogue.select("chrom", "pos", "ref"), ["chrom", "pos"]).where("allele <> ref")
    place = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy(F.desc("total"), "allele"))
    best = alts.withColumn("place", place).where(F.col("place") <= most)
    rows = F.array_sort(F.collect_list(F.struct("place", "allele")))
    return best.groupBy("chrom", "pos", "ref").agg(F.transform(rows, lambda x: x["allele"]).alias("alts"))


def gbs_calls(depth: DataFrame, sites: DataFrame) -> DataFrame:
    """Genotypes of the samples with reads at each site: the depths of ref and alts, called by likelihood."""
    by_allele = depth.groupBy("sample", "chrom", "pos").agg(F.map_from_entries(F.collect_list(F.struct("allele", "depth"))).alias("d"))
    alleles = F.concat(F.array("ref"), F.col("alts"))
    counts = F.transform(alleles, lambda a: F.coalesce(F.try_element_at("d", a), F.lit(0)).cast("int"))
    rows = by_allele.join(sites, ["chrom", "pos"]).select(F.col("sample").alias("taxon"), "chrom", "pos", counts.alias("counts"))
    return call_genotypes(rows)


def gbs_vcf(depth: DataFrame, sites: DataFrame) -> DataFrame:
    """A row a site: depth, depth of each allele, samples with data and with each allele, and the sample columns."""
    calls = gbs_calls(depth, sites)
    sums = lambda i: F.coalesce(F.sum(F.get("ad", F.lit(i)).cast("bigint")), F.lit(0))
    has = lambda i: F.count_if(F.get("ad", F.lit(i)) > 0)
    cell = F.struct("taxon", F.concat_ws(":", "gt", F.array_join("ad", ","), F.array_join("gl", ",")).alias("t"))
    return calls.groupBy("chrom", "pos").agg(
        (sums(0) + sums(1) + sums(2)).alias("dp"), F.concat_ws(",", sums(0), sums(1), sums(2)).alias("ad"), F.count_if(F.col("g1").isNotNull()).alias("ns"),
        F.concat_ws(",", has(0), has(1), has(2)).alias("ap"), F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: F.concat_ws("=", x["taxon"], x["t"])), ";").alias("samples"),
    )


def retrieve(samples: DataFrame, library: DataFrame, alleles: DataFrame, catalogue: DataFrame, max_diff: int = MOST_RETRIEVED) -> DataFrame:
    """Genotypes of new samples' tags (sample, id, ..) against a library: match, choose, add up depths, call."""
    tags = samples.select("id", "tag_r1", "tag_r2", "r1_len", "r2_len").distinct()
    chosen = choose_match(match_tags(tags, library, max_diff), tags, alleles)
    matched = samples.select("sample", F.col("id").alias("query_id"), "read_count").join(chosen, "query_id")
    depth = sample_allele_depth(matched, alleles)
    return gbs_vcf(depth, site_alleles(depth, catalogue))
