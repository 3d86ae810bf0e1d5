"""answerscope: answer-consistency analytics as DataFrame -> DataFrame operators.

* ``functions``  Column -> Column helpers (text, hashing, arrays, dense vectors)
* ``operators``  one module per operator family, DataFrame in, DataFrame out
* ``sources``    scans, sinks and resumable appends
* ``streaming``  the resumable append as a Structured Streaming sink
* ``plans``      input views, end-to-end jobs and the query catalogue
"""
