"""Row types of the data model. Locus names are strings always, so that labels such as 01 keep their zeros."""

LOCI = "locus_ord BIGINT, serotype STRING, record_id STRING, sequence STRING, length INT, source STRING"
WINDOWS = "window_idx BIGINT, window_id STRING, serotype STRING, start INT, end INT, sequence STRING, length INT"
PRIMERS = (
    "gene STRING, cluster_id STRING, amplicon_num INT, num_alleles INT, num_serotypes INT, serotypes_covered STRING, pool STRING, name STRING, "
    "left_name STRING, left_seq STRING, left_tm DOUBLE, left_gc DOUBLE, left_pos INT, right_name STRING, right_seq STRING, right_tm DOUBLE, right_gc DOUBLE, right_pos INT, "
    "product_size INT, penalty DOUBLE"
)
AMPLICONS = "primer_ord BIGINT, primer_name STRING, locus_ord BIGINT, serotype STRING, start INT, end INT, size INT, left_mismatches INT, right_mismatches INT, mismatches INT"
#: Order of the columns of an exported primer table; those that a table lacks are left out.
EXPORTED = [c.split()[0] for c in PRIMERS.split(", ")]
