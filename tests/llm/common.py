import pyarrow.parquet as pq

SMALL = "/root/testdata/sf0.001"


def table(name, where=SMALL):
    return pq.read_table(f"{where}/{name}.parquet").to_pandas()
