"""Return types of Arrow UDFs. They are objects, as a type string could only be parsed once a session exists."""

from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

TEXT, REAL, BYTES, SAMPLES = StringType(), DoubleType(), BinaryType(), ArrayType(FloatType())
COUNTS = StructType([StructField(c, LongType()) for c in ("substitutions", "deletions", "insertions", "reference_length")])
SOUND = StructType([StructField("audio", SAMPLES), StructField("sr", IntegerType())])
AUDIO = StructType([*SOUND.fields, StructField("duration_s", REAL)])
