"""Operations for preparing language-model training corpora on Spark.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
