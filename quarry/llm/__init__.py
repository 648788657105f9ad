"""Operations on training corpora: de-duplication, filtering, labelling, packing, formatting.

Nothing outside this folder imports it; the query registry adds its queries only if it is there.
"""
