"""quill.functions"""
