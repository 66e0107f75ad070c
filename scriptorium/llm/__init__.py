"""Operators for preparing training data at scale.

One module per operator, plus ``common`` (staging, hashing, text slices) and
``queries`` (the registered queries and their SQL). Nothing outside this
package imports it.
"""
