"""framequilt: Spark-native building and scoring of question-answer sets from annotated video clips."""
