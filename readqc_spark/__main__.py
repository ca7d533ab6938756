from readqc_spark.plans.api import main

main()
