from lexloom.session import checkpointed, shared_dir, spread


def test_shared_folder_is_the_session_s(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert checkpointed(spark.range(5)).count() == 5


def test_spread_deals_small_tables_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    many = spark.range(100).repartition(cores + 3)
    assert spread(many) is many
