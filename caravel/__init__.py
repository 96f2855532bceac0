"""Commerce analytics on Spark: landing files -> RAW -> STAGING -> marts and reports.

Layers
------
``functions``  column expressions (text, money, calendar, nested documents)
``operators``  DataFrame -> DataFrame building blocks (joins, ranks, sets, profiles)
``sources``    file formats, landing folders, audited loads, versioned RAW tables
``plans``      STAGING transforms, marts, reports, quality checks, recovery, refresh
``streaming``  change feeds from RAW to STAGING and the ordered run over them
"""
