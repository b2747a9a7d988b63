"""Column names and Spark schemas of the inputs and outputs.

Fixed values: these names must equal the reference's input and output column names, so that
tables written by this engine line up with the published result files.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: company table columns (input) -------------------------------------
COMPANY_ID = "Companynumber"
COMPANY_NAME = "Companyname"
REG_POSTCODE = "Registeredpostcode"
EMPLOYEES = "BestEstimateCurrentEmployees"
GVA = "BestEstimateCurrentGVA"
TURNOVER = "BestEstimateCurrentTurnover"
INNOVATE = "TotalInnovateUKFunding"
DEALROOM_M = "TotalDealroomFundingMillionPounds"
LA_CODES = "Localauthoritycodes"
POSTCODES = "Postcodes"

# ---- fixed values: lookup columns (input) ---------------------------------------------
PCDS = "pcds"
LADCD = "ladcd"
LADNM = "ladnm"
PCD7 = "pcd7"
PCD8 = "pcd8"
PCON = "pcon"
LEP1 = "lep1"
OSLAUA = "oslaua"
LAT = "lat"
LONG = "long"
LAD23CD = "LAD23CD"
LAD23NM = "LAD23NM"
RGN23CD = "RGN23CD"
RGN23NM = "RGN23NM"
LAD21CD = "LAD21CD"
LAD21NM = "LAD21NM"
RGN21CD = "RGN21CD"
RGN21NM = "RGN21NM"
ITL221CD = "ITL221CD"
ITL221NM = "ITL221NM"
GEOMETRY = "geometry"

# ---- fixed values: derived and output columns -----------------------------------------
NO_COMPANIES = "No_Companies"
NO_SITES = "No_sites"
NO_LAS = "No_LAs"
DIFFERENCE = "Difference"
POSTCODE = "Postcode"
LACODE = "LAcode"
OUT_GVA = "GVA"
OUT_TURNOVER = "Turnover"
OUT_EMPLOYEES = "Employees"
OUT_INNOVATE = "InnovateFunding"
OUT_DEALROOM = "DealroomFunding"
GVA_PER_JOB = "GVAPerJob"
GVA_JOB = "GVA_job"
GVA_PER_JOB_ROW = "GVA_per_job"

# per-site and per-LA apportioned measures, in the reference's naming
PER_SITE = {
    "turnover": "turn_per_site", "gva": "GVA_per_site", "employees": "empl_per_site",
    "innovate": "Innovate_per_site", "dealroom": "Dealroom_per_site",
}
PER_LA = {
    "turnover": "turn_per_LA", "gva": "GVA_per_LA", "employees": "empl_per_LA",
    "innovate": "Innovate_per_LA", "dealroom": "Dealroom_per_LA",
}

# the headline table's column order
HEADLINE_COLUMNS = [LAD21NM, RGN21NM, NO_COMPANIES, OUT_GVA, OUT_TURNOVER, OUT_EMPLOYEES,
                    GVA_JOB, OUT_INNOVATE, OUT_DEALROOM]

# ---- schemas ---------------------------------------------------------------------------
COMPANY_SCHEMA = T.StructType([
    T.StructField(COMPANY_ID, T.LongType(), True),
    T.StructField(COMPANY_NAME, T.StringType(), True),
    T.StructField(REG_POSTCODE, T.StringType(), True),
    T.StructField(GVA, T.DoubleType(), True),
    T.StructField(TURNOVER, T.DoubleType(), True),
    T.StructField(EMPLOYEES, T.DoubleType(), True),
    T.StructField(INNOVATE, T.DoubleType(), True),
    T.StructField(DEALROOM_M, T.DoubleType(), True),
    T.StructField(POSTCODES, T.StringType(), True),
    T.StructField(LA_CODES, T.StringType(), True),
])

# Long-form sites: a company row's own key, which need not be its (repeatable) number
COMPANY_KEY = "company_key"
