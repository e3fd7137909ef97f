"""quill.streaming"""
