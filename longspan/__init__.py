"""longspan: long-context retrieval, question-answer evaluation and corpus operators as Spark DataFrame plans."""
