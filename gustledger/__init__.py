"""Wind-farm availability on Spark: lazy DataFrame operators for alarms, signals and energy losses."""
