"""areastats: area statistics of companies -- totals, GVA per job, shares and map layers by
nation, region, local authority or ITL2 area -- as Spark DataFrame plans."""

__version__ = "0.1.0"
